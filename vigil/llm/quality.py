"""Quality classifier from weak labels.

Heuristic labellers vote keep, reject or nothing on every text.  They fall into aspects (form,
repetition, toxicity); within an aspect expectation-maximisation over the counts of vote patterns estimates how
often each labeller is right, and the posterior of the votes labels a text.  A text is good if it is
good in every aspect.  The posteriors train a hashed linear scorer (logistic, FTRL with L1), which
judges every text by its words and binned shape statistics.

Insults of languages without a word list come from labelled rows: word stems that are dense in toxic texts
and not in others form a lexicon, whose share of a text's words is one more statistic that labellers vote by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored, text_bytes

KEEP, REJECT, NONE = 1, 0, -1
BUCKETS = 1 << 22
MARKS = b" .,;:!?\"'()[]{}<>|*#%&$/\\-_=+~^`@"

#: Frequent function words of the supported languages, and insults.
STOP_WORDS = frozenset(w.encode() for w in (
    "the of and a to in is it that for on with as at by an be or are this from was "
    "der die das und ist in den zu mit von für auf ein eine im dem des nicht sich "
    "le la les de des un une et est en du que qui pour dans sur par pas au avec "
    "el la los las de del un una y es en que se por con para al no su").split())
INSULTS = frozenset(w.encode() for w in (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns "
    "dumb imbecile filth vermin garbage retard bastard asshole bitch shit fuck fucking").split())

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or part of a longer character, 3 digit, 4 white, 0 sign
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58], _CLASS[[32, 9, 10, 11, 12, 13]] = 1, 2, 2, 3, 4

STATISTICS = ("upper", "signs", "repeats", "stops", "bars", "insults", "stems", "words")
#: aspect -> labeller -> (statistic, reject at or above, keep at or below); a swapped pair rejects low values.
LABELLERS = {
    "form": {"upper": ("upper", 0.5, 0.2), "signs": ("signs", 0.25, 0.12), "stops": ("stops", 0.03, 0.12), "bars": ("bars", 0.15, 0.01)},
    "repetition": {"some": ("repeats", 0.25, 0.05), "much": ("repeats", 0.4, 0.1)},
    "toxicity": {"any": ("insults", 1, 0), "several": ("insults", 2, 0), "many": ("insults", 3, 1)},
    "lexicon": {"some": ("stems", 0.01, 0.002), "much": ("stems", 0.015, 0.005)},
}
#: Rate and weight (counts) before any vote is seen: on bad texts, on good ones.
PRIOR = ((0.4, 5.0), (0.98, 50.0))
#: Texts of fewer words get no vote on form or repetition.
LEAST_WORDS = 16
#: Lengths of stems in bytes; a stem is dense in a text if it starts two words at least, and this share of them.
STEM_SIZES, DENSE = (4, 5, 6, 7, 8), 0.01


def stem_counts(words: list[bytes]) -> Counter:
    """How many words start with each stem."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        w = w.strip(MARKS)
        for k in STEM_SIZES:
            if len(w) >= k:
                out[w[:k]] += n
    return out


def statistics(text: bytes, lexicon: frozenset[bytes] = frozenset()) -> tuple[list[float], set[bytes]]:
    """The values of ``STATISTICS`` and the distinct words, lower-cased and without marks at their ends.

    ``stems`` is the share of words that start with a stem of the lexicon (0 below two such words), or NaN
    without a lexicon."""
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=5)
    words = text.lower().split()
    n = max(1, len(words))
    plain = {w.strip(MARKS) for w in set(words)}
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    stops = sum(map(STOP_WORDS.__contains__, words)) if plain & STOP_WORDS else 0
    insulting = plain & INSULTS
    insults = sum(w.strip(MARKS) in insulting for w in words) if insulting else 0
    stems = float("nan")
    if lexicon:
        marked = {w for w in plain if any(w[:k] in lexicon for k in STEM_SIZES)}
        hits = sum(w.strip(MARKS) in marked for w in words) if marked else 0
        stems = hits / n if hits > 1 else 0.0
    letters = max(1, kinds[1] + kinds[2])
    return [kinds[1] / letters, kinds[0] / max(1, len(text) - kinds[4]), repeats / n, stops / n, words.count(b"|") / n, insults, stems, len(words)], plain - {b""}


def votes(values: list[float]) -> list[int]:
    """One vote per labeller, aspect after aspect."""
    by_name, out = dict(zip(STATISTICS, values)), []
    for aspect, labellers in LABELLERS.items():
        for name, reject, keep in labellers.values():
            x, low = by_name[name], reject < keep
            vote = REJECT if (x <= reject if low else x >= reject) else KEEP if (x >= keep if low else x <= keep) else NONE
            out.append(NONE if aspect in ("form", "repetition") and by_name["words"] < LEAST_WORDS else vote)
    return out


def features(text: bytes, lexicon: frozenset[bytes] = frozenset()) -> np.ndarray:
    """Hashed features of a text: its distinct words and the bins of its statistics."""
    values, plain = statistics(text, lexicon)
    stems = values.pop(STATISTICS.index("stems"))
    shapes = [name for name in STATISTICS[:-1] if name != "stems"]
    if values[-1] < LEAST_WORDS:
        bins = [f"\0short={min(int(values[STATISTICS.index('insults')]), 5)}".encode()]
    else:
        bins = [f"\0{name}={min(int(x), 5) if name == 'insults' else int(20 * x)}".encode() for name, x in zip(shapes, values)]
    if lexicon:
        bins.append(f"\0stems={min(int(200 * stems), 5)}".encode())
    return np.fromiter((crc32(w) % BUCKETS for w in (*bins, *plain)), dtype=np.int32, count=len(bins) + len(plain))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: (posterior of keep per pattern, accuracy per labeller, share of keep).

    ``patterns`` has a row per vote pattern and a column per labeller.  Each labeller has two rates: how
    often it is right on good texts, and on bad ones, where it may know one kind only.  The rates
    start from ``PRIOR``, which also weighs in as some counts, so that the classes can't change sides.  A pattern
    of no votes gets the share.
    """
    n = patterns.shape[1]
    right, share = np.array([[PRIOR[y][0]] * n for y in (0, 1)]), 0.8
    for _ in range(rounds):
        log = np.empty((len(patterns), 2))
        for y in (0, 1):
            hit = np.where(patterns == y, np.log(right[y]), np.where(patterns == NONE, 0.0, np.log(1 - right[y])))
            log[:, y] = hit.sum(axis=1) + np.log(share if y else 1 - share)
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        for y, w in ((1, posterior), (0, 1 - posterior)):
            mass = (w * counts)[:, None]
            voted = (mass * (patterns != NONE)).sum(axis=0)
            right[y] = ((mass * (patterns == y)).sum(axis=0) + PRIOR[y][0] * PRIOR[y][1]) / (voted + PRIOR[y][1])
        right = np.clip(right, [[0.05], [0.8]], 1 - 1e-4)
        share = float(np.clip(((posterior * counts).sum() + 1.6) / (counts.sum() + 2), 0.01, 0.99))
    weight = counts / max(1, counts.sum())
    accuracy = sum(right[y] * ((posterior if y else 1 - posterior) * weight).sum() for y in (0, 1))
    return posterior, accuracy, share


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, epochs: int = 4, alpha: float = 0.3, l1: float = 1.0, l2: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logistic weights over the hashed features by FTRL in mini-batches, and the bias."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = bias_n = 0.0
    weight = np.zeros(BUCKETS)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        at = order.permutation(len(rows))
        for part in np.array_split(at, max(1, len(at) // 32)):
            if not len(part):
                continue
            sizes = np.array([len(rows[i]) for i in part])
            idx = np.concatenate([rows[i] for i in part])
            score = np.add.reduceat(weight[idx], np.cumsum(sizes) - sizes) + bias
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[part]
            unique, inverse = np.unique(idx, return_inverse=True)
            g = np.bincount(inverse, weights=np.repeat(error, sizes))
            sigma = (np.sqrt(n[unique] + g * g) - np.sqrt(n[unique])) / alpha
            z[unique] += g - sigma * weight[unique]
            n[unique] += g * g
            zu = z[unique]
            weight[unique] = np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((1 + np.sqrt(n[unique])) / alpha + l2))
            bias_n += float(error.sum()) ** 2
            bias -= 0.1 * float(error.sum()) / (1 + bias_n ** 0.5)
    return weight.astype(np.float32), bias


def score_text(text: bytes, weight: np.ndarray, bias: float, lexicon: frozenset[bytes] = frozenset()) -> float:
    """0 to 1; a text without a word scores 0."""
    if not text.split(None, 1):
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(weight[features(text, lexicon)].sum(dtype=np.float64) + bias, -30, 30))))


def mine_lexicon(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", toxic_col: str = "toxic",
                 sample_rows: int = 4000, share: float = 0.01, lift: float = 20.0, max_stems: int = 4096) -> frozenset[bytes]:
    """Stems that mark toxic texts, from at most ``sample_rows`` labelled ids of each kind (those of the smallest hashes).

    A stem is kept if it is dense in ``share`` of the toxic texts (five at least) and ``lift`` times as often there
    as in the others; of more than ``max_stems`` the most frequent stay.  An id with several labels is toxic if any says so;
    null ids and labels don't count.  No labelled toxic text, or no other: an empty lexicon.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(toxic_col) > 0).alias("toxic"))
    pick = lambda toxic: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = stored(pick(True).unionByName(pick(False)), "quality-labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, stems = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().lower().split()
                dense = [stem for stem, n in stem_counts(words).items() if n > 1 and n >= DENSE * len(words)]
                stems += [b"", *dense]  # the empty stem counts the texts
                kinds += [toxic] * (1 + len(dense))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.bool_()), pa.array(stems, pa.binary())], names=["toxic", "stem"])

    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).join(F.broadcast(sample), "id").select("toxic", "text")  # 2 x sample_rows ids at most
    found = texts.mapInArrow(run, "toxic boolean, stem binary").groupBy("stem").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    found = stored(found, "quality-stems")
    total = found.where(F.length("stem") == 0).first()
    if total is None or not total["bad"] or not total["good"]:
        return frozenset()
    often = F.col("bad") >= max(5.0, share * total["bad"])
    marks = F.col("bad") / total["bad"] >= lift * (F.col("good") + 1) / total["good"]
    kept = found.where((F.length("stem") > 0) & often & marks).orderBy(F.col("bad").desc(), "stem").limit(max_stems)
    return frozenset(bytes(r["stem"]) for r in kept.collect())


def _votes_of(docs: DataFrame, text_col: str, lexicon: frozenset[bytes]) -> DataFrame:
    """``key, pattern`` of every row: a hash of the text and its votes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([",".join(map(str, votes(statistics(t.as_py(), lexicon)[0]))) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "pattern"])

    return docs.select(F.xxhash64(text_col).alias("key"), text_bytes(text_col).alias("text")).mapInArrow(run, "key bigint, pattern string")


def train_scorer(docs: DataFrame, text_col: str = "text", sample_rows: int = 8000, lexicon: frozenset[bytes] = frozenset()) -> dict:
    """``weight, bias, accuracy, lexicon``.  The votes of all rows enter the label model; the scorer is fitted to at
    most ``sample_rows`` different texts (those of the smallest hashes), the bound of what the driver gets."""
    voted = stored(_votes_of(docs, text_col, lexicon), "quality-votes")
    table = voted.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    names = [(a, n) for a, labellers in LABELLERS.items() for n in labellers]
    all_votes = np.array([[int(v) for v in r["pattern"].split(",")] for r in table], dtype=int).reshape(len(table), len(names))
    counts = np.array([r["count"] for r in table], dtype=float)
    good, accuracy = np.ones(len(table)), {}
    for aspect in LABELLERS:
        columns = [i for i, (a, _) in enumerate(names) if a == aspect]
        if (all_votes[:, columns] == NONE).all():  # as the lexicon's, without labels
            continue
        posterior, right, _ = label_model(all_votes[:, columns], counts)
        good *= posterior
        accuracy |= {names[i]: float(x) for i, x in zip(columns, right)}
    label = {r["pattern"]: p for r, p in zip(table, good)}

    chosen = voted.groupBy("key").agg(F.min("pattern").alias("pattern")).orderBy(F.xxhash64("key")).limit(sample_rows)
    pattern = {r["key"]: r["pattern"] for r in chosen.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py(), lexicon).tobytes() for t in batch.column(1)], pa.binary())], names=["key", "features"])

    keys = docs.sparkSession.createDataFrame([(k,) for k in pattern], "key bigint")
    texts = docs.select(F.xxhash64(text_col).alias("key"), text_bytes(text_col).alias("text")).join(F.broadcast(keys), "key", "left_semi")  # sample_rows keys at most
    found = {r["key"]: np.frombuffer(r["features"], dtype=np.int32) for r in texts.mapInArrow(run, "key bigint, features binary").dropDuplicates(["key"]).collect()}
    order = sorted(found)
    weight, bias = fit_scorer([found[k] for k in order], np.array([label[pattern[k]] for k in order]))
    return {"weight": weight, "bias": bias, "accuracy": accuracy, "lexicon": lexicon}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, chance that the text is good) added at the end."""
    shared = docs.sparkSession.sparkContext.broadcast((model["weight"], model["bias"], model["lexicon"]))  # BUCKETS floats, max_stems stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, lexicon = shared.value
        for batch in batches:
            scores = [score_text((t.as_py() or "").encode(), weight, bias, lexicon) for t in batch.column(names.index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, score_col])

    names = docs.columns
    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(score_col)).schema)


def judge_quality(docs: DataFrame, threshold: float = 0.5, sample_rows: int = 8000, text_col: str = "text", score_col: str = "score", keep_col: str = "keep",
                  labels: DataFrame | None = None, id_col: str = "doc_id", toxic_col: str = "toxic") -> DataFrame:
    """``docs`` with ``score_col`` and ``keep_col`` (score at or above ``threshold``).

    ``labels`` (``id_col, toxic_col``), if given, yield the lexicon of toxic stems (see ``mine_lexicon``).

    A null, empty or wordless text scores 0.  Equal texts score the same; repeated rows are judged one by
    one.  Other columns are passed on.  An empty table stays empty.
    """
    lexicon = mine_lexicon(docs, labels, text_col, id_col, toxic_col) if labels is not None else frozenset()
    return score(docs, train_scorer(docs, text_col, sample_rows, lexicon), text_col, score_col).withColumn(keep_col, F.col(score_col) >= threshold)

"""Plan properties of the registered queries: no Python evaluation outside the network UDF,
pruned scans, and no single-partition exchange outside the small summary steps."""

import os
import sys

import __spark_entry__ as E
from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from plan_report import STREAM_OR_SIDE_EFFECT, summarise  # noqa: E402


def _plan(spark, name):
    return E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


def test_no_python_outside_the_network_udf(spark):
    for name in sorted(set(E.queries()) - set(E.LLM_QUERIES)):
        if name in STREAM_OR_SIDE_EFFECT:
            continue
        s = summarise(_plan(spark, name))
        assert s["python"] == (1 if name == "classify_accuracy_udf" else 0), name


def test_scans_read_only_needed_columns(spark):
    s = summarise(_plan(spark, "parse_events"))
    assert s["scans"] == ["struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>"]
    s = summarise(_plan(spark, "generate_vectors"))
    assert s["scans"] == ["struct<l_orderkey:bigint,l_linenumber:int>"]


def test_flagship_has_one_global_step(spark):
    # the only single-partition exchange is the prefix sum over per-block totals
    assert summarise(_plan(spark, "interval_attention"))["single_partition"] <= 1

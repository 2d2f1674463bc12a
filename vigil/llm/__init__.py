"""Training-data operators over the document and page tables (one module per operator).

Each module holds one operator with a general interface (column names and thresholds are
parameters); ``vigil.llm.queries`` registers the thin ``opN_<name>`` queries on top of them.
"""

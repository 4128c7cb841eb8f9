"""Secrets: the dictionary feature."""

from strandframe.llm import secrets


def test_dictionary_leaves_candidates_out(spark):
    """A random run is no word by standing in its own value, nor in another candidate's token; a real word is one."""
    rows = [(1, "key=qzxkvbnm0123456789 and qzxkvbnm0123456789"), (2, "set customer-invoice-2024-01-02 now"), (3, "(qzxkvbnm-00000000001)"),
            (4, "The Customer pays each invoice."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.at): r.covered for r in secrets.with_features(secrets.candidates(docs), docs).collect()}
    assert got == {(1, 0): 0.0, (1, 2): 0.0, (2, 1): 15 / 27, (3, 0): 0.0}

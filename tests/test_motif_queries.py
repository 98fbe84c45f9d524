"""Motif queries over k-mer tables of several codes."""

import itertools

from strandline.plans import QUERIES, motifs


def test_search_covers_every_code(spark, monkeypatch):
    rows = []
    for code, focus, after in (("a", "A", "G"), ("m", "C", "G")):
        for k in map("".join, itertools.product("ACGT", repeat=4)):
            kmer = k[:2] + focus + k[2:]
            high = k[2] == after
            rows += [("high", kmer, code, 9 if high else 1), ("low", kmer, code, 1 if high else 9)]
    monkeypatch.setattr(motifs, "_levels", lambda spark, d: spark.createDataFrame(rows, "level string, kmer string, code string, n long"))
    for query in ("c16_search", "c17_refine"):
        got = {(r["code"], r["motif"], r["offset"], r["high"], r["low"]) for r in QUERIES[query](spark, "").collect()}
        assert {("a", "AG", 0, 576, 64), ("m", "CG", 0, 576, 64)} <= got

"""The language model's trie as a file, against the same trie in other pieces and the joined levels."""

import gc
import re

import numpy as np
import pytest

from tidemark.llm import ppm


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_a_large_trie_is_mapped_and_not_held(monkeypatch):
    """Workers look up a file: the memory of their own doesn't grow with the trie; nor does the builder's (both held all levels before)."""

    def own():
        gc.collect()
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024

    monkeypatch.setattr(ppm, "PIECE", 1 << 14, raising=False)
    rng = np.random.default_rng(0)
    leaves, counts = np.unique(rng.integers(0, 1 << 48, 600_000).astype(np.uint64) & np.uint64(0xFF0F0F0F0FFF), return_counts=True)
    began = own()
    trie = ppm.Trie(leaves, counts)
    assert own() - began < 25
    assert (trie.levels[0][0].keys == leaves).all() and (trie.levels[0][0].find(leaves) == np.arange(len(leaves))).all()


def test_pieces_of_a_trie_make_the_same_trie(monkeypatch):
    rng = np.random.default_rng(1)
    codes = np.concatenate([ppm.grams(own) for own in ppm.blocks([bytes(rng.integers(97, 101, 3000).astype(np.uint8)), b"spam " * 300])])
    leaves, counts = np.unique(codes, return_counts=True)
    probes = np.concatenate([codes, rng.integers(0, 1 << 48, 500).astype(np.uint64)])
    whole = ppm.Trie(leaves, counts).log10(probes)
    for piece in (16, 50, 300):
        monkeypatch.setattr(ppm, "PIECE", piece)
        mixed = rng.permutation(len(leaves))
        assert (ppm.Trie(leaves[mixed], counts[mixed]).log10(probes) == whole).all()


def test_joined_levels_take_long_texts_by_blocks(spark):
    """What is looked up of a text leaves the task block by block; a row held all of it before."""
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Zeta7"], 120_000).tolist())
    docs = frame(spark, [long, "alpha beta", None, long[:300_000] + "omega" + long[:300_000]])
    model = ppm.Model(docs.limit(2))
    small = {r.doc_id: r for r in ppm.score(docs, model).collect()}
    joined = {r.doc_id: r for r in ppm.score(docs, model, leaves_limit=0).collect()}
    assert len(small) == len(joined) == 4
    for k in small:
        assert joined[k].score == pytest.approx(small[k].score, rel=1e-9) and joined[k].n_tokens == small[k].n_tokens

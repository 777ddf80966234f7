"""Best-fit packing: the plan against placing pieces one by one, ids against the tokenizers library, and edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import docs_frame, empty

from quarry.llm import bestfit
from quarry.llm.queries import WORD_TOKENIZER_FILE, tokenizer_path


def one_by_one(lengths, capacity):
    """The rooms that best-fit decreasing leaves, a piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50, 100, 2048])
    common = [1, 2, 3, capacity // 3 + 1]
    counts = Counter(rng.randint(1, capacity) if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.randint(1, 300)))
    lengths = np.array([n for n in counts for _ in range(counts[n])], np.int64)
    ranks = np.array([k for n in counts for k in range(counts[n])], np.int64)
    bins, offsets = bestfit.places(bestfit.plan_bins(counts, capacity), lengths, ranks)
    held = {}
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True)):
        assert held.setdefault(b, 0) == o
        held[b] += n
    assert sorted(capacity - n for n in held.values()) == one_by_one(lengths.tolist(), capacity)


def test_plan_is_bounded_by_the_capacity():
    rng = random.Random(1)
    sizes = [len(bestfit.plan_bins({n: rng.randint(1, scale) for n in range(1, 513)}, 512)[0]) for scale in (10**3, 10**6, 10**9)]
    assert max(sizes) < 8 * 512


def test_tightest_bin():
    tree, held = bestfit.TightestBin(37), [0] * 38
    rng = random.Random(2)
    for _ in range(400):
        at = rng.randrange(38)
        add = 1 if not held[at] or rng.random() < 0.4 else -1
        tree.add(at, add)
        held[at] += add
        for least in range(38):
            assert tree.find(least) == next((c for c in range(least, 38) if held[c]), None)


ODD = ["", "  ", "\n", "á é ́x Σας ΣΑΣ İI ß K", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x\x1cy z w\x85q\tt\x00", "it's we'll 'S 12345 !!?? ... \n\n\r\n", "한글 각 ﬁ ½ ² _a_", "😀 x’y z’", "a" * 5000, "Ⱥb ×÷ don't AAA A a", "İz tab\tq"]


def test_ids_are_the_librarys(monkeypatch):
    words = bestfit.WordIds(tokenizer_path(WORD_TOKENIZER_FILE))
    assert words.encoding is not None
    rng = random.Random(4)
    alphabet, stems = "abcXYZéèüßÀÉñÿğİıœæ'!.,;<|>-1239½¼ \n", sorted(t.removesuffix("</w>") for t in words.tokenizer.get_vocab())
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += [" ".join(rng.choice(stems) + rng.choice(["", rng.choice(stems)]) for _ in range(50)) for _ in range(400)]
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, words.dtype).tolist() for x in words.texts(texts)] == want
    monkeypatch.setattr(bestfit, "BATCH_CHARS", 100)  # many slices
    assert [np.frombuffer(x, words.dtype).tolist() for x in words.texts(texts)] == want
    words.encoding = None
    assert [np.frombuffer(x, words.dtype).tolist() for x in words.texts(texts)] == want
    other = bestfit.WordIds(tokenizer_path())  # keeps white space: the library alone
    assert other.encoding is None and np.frombuffer(other.texts(["a b\n"])[0], other.dtype).tolist() == other.tokenizer.encode("a b\n").ids


def test_packing_whole_tables(spark):
    from tokenizers import Tokenizer

    path, capacity = tokenizer_path(WORD_TOKENIZER_FILE), 64
    ref = Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = [None, *ODD, *(" ".join(rng.choice(["alpha", "of", "été", "xyzzy"]) for _ in range(rng.randint(1, 200))) for _ in range(150)), *["the same text"] * 300]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    docs = docs_frame(spark, rows).repartition(7)
    out = bestfit.pack_best_fit(docs, path, capacity).toPandas()
    assert out.columns.tolist() == ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
    for i, g in out.sort_values("piece").groupby("doc_id"):
        want = ref.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == want
        assert g.piece.tolist() == list(range(len(g))) and (g.length[:-1] == capacity).all()
        assert g.start.tolist() == [capacity * k for k in range(len(g))] and all(len(x) == 4 * n for x, n in zip(g.ids, g.length, strict=True))
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= capacity
    assert sorted(capacity - out.groupby("sequence_id").length.sum()) == one_by_one(out.length.tolist(), capacity)


def test_packing_edges(spark):
    path = tokenizer_path(WORD_TOKENIZER_FILE)
    assert bestfit.pack_best_fit(empty(spark), path).count() == 0
    rows = [(None, None, "en", "a"), (None, "x", "en", "a"), (1, "x", "en", "a"), (1, "x", "en", "a"), (1, "y z", "en", "a")]
    out = bestfit.pack_best_fit(docs_frame(spark, rows), path, capacity=2).toPandas()
    assert sorted(out.length) == [1, 1, 2, 2, 2, 2] and out.sequence_id.nunique() == 5
    with pytest.raises(ValueError):
        bestfit.pack_best_fit(docs_frame(spark, rows), path, capacity=0)

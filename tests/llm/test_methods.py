"""The operators' methods, without Spark."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import anchors, language, licenses, mixing, neighbours, packing, repeats, shingles, topk, warc


def test_loser_tree_merges_like_sorted():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(0, 15))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(itertools.chain(*runs))


def test_warc_record_round_trip():
    import gzip

    one = warc._record(3, "http://a.b/c", 5, "response", None, b"x\r\n\r\ny", warc.payload_digest(b"x\r\n\r\ny"))
    two = warc._record(4, "", 6, "revisit", 3, b"x", warc.payload_digest(b"x"))
    (h1, p1), (h2, p2) = warc._parse(one), warc._parse(two)
    assert (p1, h1["X-Capture-Number"]) == (b"x\r\n\r\ny", "3")
    assert p2 == b"" and h2["X-Refers-To-Capture-Number"] == "3"
    assert [gzip.decompress(b)[:8] for b in (one, two)] == [b"WARC/1.1"] * 2
    with pytest.raises(ValueError):
        warc._parse(one[:-5])


def test_url_keys_order_by_host_labels():
    assert warc.url_key("http://www.B.com/p?q=1#f") == "com,b,www)/p?q=1"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_hilbert_key_is_a_bijection_of_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert set(np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1)) == {1}


def test_token_ids_are_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, own = Tokenizer.from_file(path), packing.ByteBpe(path, packing.PRE_TOKENS)
    ref.encode_special_tokens = True
    texts = ["", " ", "a  b\n\n c\t d", "it's we'll   x", "naïve Größe 東京 \U0001f600 ​ x", "<|endoftext|> 12 345,6", "x" * 3000, " \n" * 50]
    for t in texts:
        assert own.ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t[:20])


def test_added_tokens_in_a_text_have_their_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, own = Tokenizer.from_file(path), packing.ByteBpe(path, packing.PRE_TOKENS)
    end = "<|endoftext|>"
    assert own.text_ids(f"a {end} b").tolist() == [64, 220, 50256, 275]
    for t in ["", "a b", end, f"a  {end}  \n", f"{end}{end}x", f"it's{end}'s", "<|endoftext|", f"é {end[:-1]}{end} 12"]:
        assert own.text_ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)


def test_kneser_ney_sums_to_one_in_the_training_language():
    text = "the cat sat on the mat and the dog ran to the hat " * 5
    model = language.Models({"x": language.fit([text])}, {"x": 9.0})
    alphabet = np.unique(language.fold(text))
    for context in ("the ", "and ", " mat"):
        codes = language.fold(context)
        total = sum(float(np.exp(model.log_probabilities(np.append(codes, c).astype(np.uint32)))[0, 0]) for c in alphabet)
        assert 0.9 < total <= 1.001


class PlainKneserNey:
    """Interpolated Kneser-Ney by its definition, over dictionaries of character tuples."""

    def __init__(self, texts):
        order, pad = language.ORDER, [language.PAD] * (language.ORDER - 1)
        self.counts, self.alphabet = {n: Counter() for n in range(1, order + 1)}, set()
        seen = set()
        for t in texts:
            codes = [*pad, *language.fold(t).tolist()]
            self.alphabet |= set(codes[order - 1 :])
            for i in range(order - 1, len(codes)):
                self.counts[order][tuple(codes[i - order + 1 : i + 1])] += 1
        for n in range(order, 1, -1):  # a lower order counts the different left neighbours
            for gram in self.counts[n]:
                if (n, gram) not in seen:
                    seen.add((n, gram))
                    self.counts[n - 1][gram[1:]] += 1
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, grams in self.counts.items():
            of = Counter(grams.values())
            self.discount[n] = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
            for gram, c in grams.items():
                self.total[n, gram[:-1]] = self.total.get((n, gram[:-1]), 0) + c
                self.kinds[n, gram[:-1]] = self.kinds.get((n, gram[:-1]), 0) + 1

    def probability(self, gram):
        if not gram:
            return 1 / (len(self.alphabet) + 1)
        n, below = len(gram), self.probability(gram[1:])
        if (n, gram[:-1]) not in self.total:
            return below
        total, d = self.total[n, gram[:-1]], self.discount[n]
        return max(self.counts[n][gram] - d, 0) / total + d * self.kinds[n, gram[:-1]] / total * below

    def cross_entropy(self, text):
        codes = [*[language.PAD] * (language.ORDER - 1), *language.fold(text).tolist()]
        n = len(codes) - language.ORDER + 1
        return -sum(math.log(self.probability(tuple(codes[i : i + language.ORDER]))) for i in range(n)) / n


def test_kneser_ney_against_its_definition():
    rng = random.Random(12)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))
    texts = {"a": [prose("aabbbcde", 40) for _ in range(6)] + ["a"], "b": [prose("bdéüxyz", 60) for _ in range(3)], "c": ["x y"]}
    models = language.Models({k: language.fit(v) for k, v in texts.items()}, dict.fromkeys(texts, 1.0))
    plain = {k: PlainKneserNey(v) for k, v in texts.items()}
    asked = [prose("abcdeéxyzq", 8) for _ in range(60)] + ["a", "q", "𐐀 b", *texts["a"], prose("ab", 500)]
    lengths, found = models.score(asked)
    for row, n, text in zip(found, lengths, asked, strict=True):
        assert n == len(language.fold(text))
        assert np.allclose(row, [plain[k].cross_entropy(text) for k in models.languages], rtol=2e-5, atol=2e-5), text


def test_long_texts_score_as_their_parts_together():
    texts = ["abc de " * 30_000, "x"]
    model = language.Models({"x": language.fit(["abc de abd ce"]), "y": language.fit(["xyz zyx"])}, {"x": 1.0, "y": 1.0})
    n, ce = model.score(texts)
    one = model.score([texts[1]])[1][0]
    assert n[0] == len(language.fold(texts[0])) and np.allclose(ce[1], one)
    assert ce[0].argmin() == 0


def test_sorted_hashes_find():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = language.SortedHashes(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1)) == -1).sum() >= len(keys) - 2


def brute_blocks(words, t, threshold):
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + t.width) + 1):
            if len(set(words[i:j]) & t.rank.keys()) >= t.need:
                return True
    return False


def test_license_blocks_against_brute_force():
    rng = random.Random(2)
    template = {"t": "alpha beta gamma delta epsilon zeta"}
    t = licenses.order_templates(template, {b"alpha": 9}, 0.8)[0]
    vocabulary = [b"alpha", b"beta", b"gamma", b"delta", b"epsilon", b"zeta", b"q", b"r", b"s"]
    for _ in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 16))]
        got = list(licenses.blocks_with(words, set(words), t))
        assert bool(got) == brute_blocks(words, t, 0.8), words
        for s, n, c in got:
            assert n <= t.width and len(set(words[s : s + n]) & t.rank.keys()) / 6 == c >= 0.8


def test_phrase_places_overlap_and_words():
    words = licenses.words_of("CC-BY cc by, by cc by")
    assert words == [b"cc", b"by", b"cc", b"by", b"by", b"cc", b"by"]
    assert licenses.phrase_places(words, [b"cc", b"by"]) == [0, 2, 5]
    assert licenses.words_of("Größe_3 é") == ["größe".encode(), b"3", "é".encode()]


def test_block_top_k_against_brute_force():
    rng = np.random.default_rng(4)
    q, c = rng.integers(-3, 4, (40, 10)), rng.integers(-3, 4, (700, 10))
    q_ids, c_ids = np.arange(40) * 20, np.arange(700)
    rows, cols, score, _ = topk.block_top_k(q_ids, q, c_ids, c, 20)
    exact = q @ c.T
    for i in range(40):
        order = [j for j in np.lexsort((c_ids, -exact[i])) if c_ids[j] != q_ids[i]][:20]
        assert cols[rows == i].tolist() == order and score[rows == i].tolist() == exact[i][order].tolist()


def test_segment_bound_holds():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 11)), rng.normal(size=(50, 11))
    for s in (1, 2, 4, 11):
        bound = topk.segment_statistics(a, s) @ topk.segment_statistics(b, s).T
        assert (bound >= a @ b.T - 1e-9).all()


def test_hnsw_finds_links_in_clusters_and_noise():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([rng.normal(size=(1500, 16)), centres.repeat(10, 0) + 0.05 * rng.normal(size=(600, 16)), centres[:1].repeat(300, 0) + 0.01 * rng.normal(size=(300, 16))])
    x = neighbours._unit(x)
    ids = np.arange(len(x))
    graph = neighbours.Hnsw(x)
    graph = neighbours.Hnsw.load(graph.dump())
    got = set()
    for row, col in neighbours.links_in_shard(graph, x, ids, x, ids, 0.95, neighbours.audited_beam(graph, x, ids, x, ids, 0.95)[0]):
        got |= set(zip(row.tolist(), col.tolist(), strict=True))
    truth = np.argwhere((x @ x.T >= 0.95) & (ids[:, None] != ids[None]))
    truth = set(map(tuple, truth.tolist()))
    assert got <= truth and len(got) >= 0.98 * len(truth)


def test_tiny_graphs():
    for n in (1, 2, 5, 40):
        x = neighbours._unit(np.random.default_rng(n).normal(size=(n, 4)))
        ids, _ = neighbours.Hnsw(x).search(x, min(n, 8))
        assert (ids[:, 0] >= 0).all()


def test_anchor_blocks_depend_on_window_bytes_alone():
    rng = random.Random(7)
    length = 100
    shared = bytes(rng.randrange(97, 123) for _ in range(400))
    a = bytes(rng.randrange(97, 123) for _ in range(333)) + shared + b"tail" * 50
    b = b"aaaa" * 70 + shared

    def key_of(text):
        out = {}
        for keys, starts, counts, at in anchors.anchor_blocks(text, length):
            for k, s, n, p in zip(keys, starts, counts, at, strict=True):
                for w in range(s, s + n):
                    out[w] = (k, p - w)
                    assert 0 <= p - w <= length - anchors.GRAM
        assert sorted(out) == list(range(len(text) - length + 1))
        return out

    ka, kb = key_of(a), key_of(b)
    windows = {}
    for text, keys in ((a, ka), (b, kb)):
        for w, k in keys.items():
            assert windows.setdefault(text[w : w + length], k) == k


def test_window_classes_and_factors():
    data = b"abcabcabc" * 20 + b"xyz" + b"abcabcabc" * 9
    raw = np.frombuffer(data, np.uint8)
    length = 64
    starts = np.arange(len(data) - length + 1)
    classes = repeats.window_classes(raw, starts, length)
    same = {}
    for s, c in zip(starts.tolist(), classes.tolist(), strict=True):
        assert same.setdefault(c, data[s : s + length]) == data[s : s + length]
    assert len(same) == len(set(data[s : s + length] for s in starts.tolist()))
    earlier, later = repeats.repeated_factors(classes, starts)
    count = Counter(data[s : s + length] for s in starts.tolist())
    seen = set()
    for s in starts.tolist():
        w = data[s : s + length]
        assert earlier[s] == (w in seen)
        seen.add(w)
        assert (earlier[s] or later[s]) == (count[w] > 1)


def test_link_sets_against_brute_force():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(25):
        base = np.unique(rng.integers(1, 1 << 62, int(rng.integers(1, 900)), dtype=np.uint64))
        sets.append(base)
        for _ in range(int(rng.integers(0, 5))):
            keep = base[rng.random(len(base)) > rng.random() * 0.25]
            sets.append(np.unique(np.concatenate([keep, rng.integers(1, 1 << 62, int(len(base) * rng.random() * 0.15), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        o = len(np.intersect1d(sets[i], sets[j]))
        if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    truth = [find(i) for i in range(len(sets))]
    for sides in (None,):
        forest = neighbours.Forest(len(sets))
        for i, j in shingles.link_sets(sets, 80, sides):
            forest.join(np.array([i]), np.array([j]))
        got = [int(forest.roots(np.array([i]))[0]) for i in range(len(sets))]
        assert got == truth


def test_shingles_of_short_blank_and_null_texts():
    assert len(shingles.shingle_set(None, 5)) == len(shingles.shingle_set(" \t\n", 5)) == 0
    assert len(shingles.shingle_set("a b", 5)) == 1
    assert (shingles.shingle_set("A b C d E f", 5) == shingles.shingle_set("a\tb c  d e f\n", 5)).all()
    rows = np.zeros(3, shingles.ROW)
    rows["token"], rows["n"] = [5, 6, 7], [1, 2, 3]
    assert (shingles.unpack(shingles.pack(rows)) == rows).all()


def test_temperature_weights_meet_their_targets():
    tokens = {"a": 9000, "b": 700, "c": 300, "d": 0}
    exponent, weights, factor = mixing.temperature_weights(tokens, max_repetition=3.0)
    share = {s: n / 10000 for s, n in tokens.items() if n}
    assert max(weights[s] / share[s] for s in share) == pytest.approx(3.0, abs=1e-6) and 0 < exponent < 1 and factor == 1
    exponent, weights, _ = mixing.temperature_weights(tokens, target_entropy=0.8)
    assert mixing.entropy(weights) == pytest.approx(0.8 * np.log(3), abs=1e-6)
    _, weights, factor = mixing.temperature_weights(tokens, max_repetition=1.5, cover=True)
    epochs = {s: factor * weights[s] / share[s] for s in share}
    assert min(epochs.values()) == pytest.approx(1) and max(epochs.values()) == pytest.approx(1.5)
    with pytest.raises(ValueError):
        mixing.temperature_weights(tokens, max_repetition=0.5)

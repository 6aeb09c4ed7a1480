"""Parts of the operators against plain definitions."""

import random
import re
import tracemalloc
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from statuta.llm import bagminhash, decontamination, packing, sharding, topk, toxicity, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def test_words_over_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 64)
    random.seed(3)
    texts = [" ".join(random.choice(["the", "of", "Éa", "x1", "a-b", "ñ"]) for _ in range(n)) for n in (0, 1, 5, 400, 3, 0, 60)] + [None, "z" * 500]
    hashes, cuts = words.word_hashes(pa.array(texts))
    seen = {}
    for text, a, b in zip(texts, cuts, cuts[1:]):
        own = plain_words(text or "")
        assert len(own) == b - a
        for word, h in zip(own, hashes[a:b]):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_beyond_ascii():
    """Unicode punctuation and spaces part words, and characters of unspaced scripts are words."""
    pairs = [
        ("“don’t”—stop…here\u00a0now\u2003you\u3000¿qué? 3×4 a÷b", "don t stop here now you qué 3 4 a b"), ("今日は、晴れ。", "今 日 は 晴 れ"), ("ラーメンabc", "ラ ー メ ン abc"),
        ("ไปที่นี่", "ไ ป ที่ นี่"), ("naïve Straße привет", "naïve straße привет"), ("", ""), ("a b", "a b"), ("हिन्दी शब्द", "हिन्दी शब्द"),
    ]
    for texts in ([p[0] for p in pairs], [p[0] for p in pairs[4:]]):
        got, cuts = words.word_hashes(pa.array([*texts, None]))
        want, ends = words.word_hashes(pa.array([*(dict(pairs)[t] for t in texts), None]))
        assert (got == want).all() and (cuts == ends).all()
    for text, n in zip(pairs, (11, 5, 5, 4, 3, 0, 2, 2)):
        assert len(words.word_hashes(pa.array([text[0]]))[0]) == n == len(text[1].split())
    part = pa.array(["x", "今日", "ab—c", "y"])[1:3]  # a slice of a larger array
    assert words.word_hashes(part)[1].tolist() == [0, 2, 4]


@pytest.mark.parametrize("window", [8, 50, 2048])
def test_plan_is_best_fit_decreasing(window):
    random.seed(window)
    for _ in range(60):
        sizes = [random.randint(1, window - 1 if random.random() < 0.5 else max(1, window // 5)) for _ in range(random.randint(0, 200))]
        rooms, opened = [], 0
        for s in sorted(sizes, reverse=True):
            i = bisect_left(rooms, s)
            opened += i == len(rooms)
            room = window if i == len(rooms) else rooms.pop(i)
            if room > s:
                insort(rooms, room - s)
        counts, used = Counter(sizes), Counter()
        taken = set()
        rows = packing.plan(dict(counts), window).tolist()
        for i, (length, rank, first, each, offset) in enumerate(rows):
            end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else counts[length]
            for k in range(end - rank):
                w, o = first + k // each, offset + length * (k % each)
                assert not taken & {(w, x) for x in range(o, o + length)} and o + length <= window
                taken |= {(w, x) for x in range(o, o + length)}
                used[w] += length
        assert set(used) == set(range(opened)) and sorted(window - v for v in used.values() if v < window) == rooms


def test_tokenizer_is_exact():
    loaded, own = Tokenizer.from_file(PATH), packing.Tokenizer(PATH)
    assert own._quick is not None
    odd = [
        "It's O'Neil's don't 're 'S x'.", "a b c\x1cd \x85e", "<|endoftext|>. a<|endoftext|>b <|startoftext|>!", "é! ñ... İx. ΣΑΣ. ΟΔΟΣ", "", "  \n\n ",
        "１２３. ½! ª? 漢字.", "x≠. don't'. '' '.' a'.", "Q. 'll'll", "ab́. ́. á̧,", "#$%&&& &&&*** a$$$b###", "Übermaß École ÿ Ÿ ß µ",
    ]
    random.seed(1)
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßABCÉÑ"
    odd += [" ".join("".join(random.choices(letters, k=random.randint(1, 12))) + random.choice(["", ".", "!!", ",", "%%%"]) for _ in range(400))]
    for text, ids in zip(odd, own.ids(odd)):
        assert ids == np.array(loaded.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_joining_by_ids_is_joining_by_merges():
    """Joining whatever pair has the lowest id gives the merge of the file for every token, so both ways agree on every word."""
    import json

    model = json.loads(Tokenizer.from_file(PATH).to_str())["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    joined = {}
    for i, (a, b) in enumerate(merges):
        assert model["vocab"][a + b] == 512 + i
        end = (a + b).endswith("</w>")
        parts = list((a + b).removesuffix("</w>"))
        parts[-1] += "</w>" * end
        while len(parts) > 2:
            best, k = min((joined.get(parts[k] + parts[k + 1], len(merges)), k) for k in range(len(parts) - 1))
            assert best < i
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert tuple(parts) == (a, b)
        joined[a + b] = i


def test_maximal_segments():
    """Every segment is positive and maximal: the definition by recursion, best segment first."""

    def best_first(score, low, high):
        found = [(score[low:a].sum(), a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
        sums = [(score[a:b].sum(), -(b - a), a, b) for _, a, b in found]
        top = max(sums, default=(0,))
        if top[0] <= 0:
            return []
        _, _, a, b = top
        return best_first(score, low, a) + [(a, b - 1)] + best_first(score, b, high)

    random.seed(5)
    for _ in range(60):
        n = random.randint(1, 14)
        score = np.array([random.choice([-0.25, -0.25, random.uniform(0.1, 2), random.uniform(-2, -0.1)]) for _ in range(n)])
        at = np.flatnonzero(score != -0.25)
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(at, score[at], -0.25)]
        assert got == best_first(score, 0, n)


def test_hilbert_curve_is_continuous():
    bits, n = 3, 3
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
    place = sharding.hilbert(cells, bits)
    assert sorted(place) == list(range(1 << bits * n))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_signatures_estimate_weighted_similarity():
    random.seed(1)
    errors = []
    for _ in range(40):
        keys = [random.getrandbits(63) for _ in range(40)]
        a = Counter({k: random.choice([1, 1, 2, 3, 5, 9, 20, 100]) for k in keys})
        b = Counter({k: max(1, v + random.choice([0, 0, 0, 1, -1, 5, -3])) for k, v in a.items() if random.random() < 0.9})
        rows = [np.array(sorted(x), np.uint64) for x in (a, b)]
        counts = [np.array([x[int(k)] for k in r]) for x, r in zip((a, b), rows)]
        times = bagminhash.signatures(np.concatenate(rows), np.concatenate(counts), np.array([0, len(rows[0]), len(rows[0]) + len(rows[1])]))
        true = sum((a & b).values()) / sum((a | b).values())
        errors.append((times[0] == times[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signature_does_not_depend_on_company():
    text = "one two three four five six one two three four five six seven eight"
    alone = bagminhash.band_keys(bagminhash.signatures(*bagminhash.shingles(pa.array([text]))))
    among = bagminhash.band_keys(bagminhash.signatures(*bagminhash.shingles(pa.array(["other words", "", text, "x " * 900]))))
    assert (alone[0] == among[2]).all()


def test_search_against_brute_force():
    random = np.random.default_rng(2)
    for big in (1, 2**24):
        rows = random.integers(-3, 4, (700, 5)).astype(float) * big
        ids = random.permutation(1000)[:700]
        asked, queries = ids[:40], rows[:40]
        got, scores = topk.search(topk.Tree(ids, rows), asked, queries, 5, np.full(40, -np.inf))
        for q, own, g, s in zip(queries, asked, got, scores):
            true = sorted(((-int(x), int(i)) for x, i in zip(rows @ q, ids) if i != own))[:5]
            assert [(-int(x), int(i)) for x, i in zip(s, g)] == true


def test_descent_visits_few_leaves_of_clusters():
    """A query takes the leaves of its own cluster and few others; rows that are all alike are split too."""
    random = np.random.default_rng(5)
    centres = random.integers(-200, 200, (64, 8)).astype(float)
    rows = np.repeat(centres, 200, 0) + random.integers(-3, 4, (12_800, 8))
    ids = np.arange(len(rows))
    tree = topk.Tree(ids, rows)
    leaves = int((tree.left < 0).sum())
    got, scores = topk.search(tree, ids[:100], rows[:100], 5, np.full(100, -np.inf))
    for q in range(100):
        true = sorted((-int(x), int(i)) for x, i in zip(rows @ rows[q], ids) if i != q)[:5]
        assert [(-int(x), int(i)) for x, i in zip(scores[q], got[q])] == true
    assert leaves >= 100 and tree.visited < 0.15 * 100 * leaves
    # a floor above all scores prunes the whole tree
    before = tree.visited
    assert (topk.search(tree, ids[:100], rows[:100], 5, np.full(100, 1e9))[0] == -1).all() and tree.visited == before
    alike = topk.Tree(ids[:1000], np.ones((1000, 3)))
    assert (topk.search(alike, ids[:1], np.ones((1, 3)), 5, np.full(1, -np.inf))[0] == [[1, 2, 3, 4, 5]]).all()


def test_sums_beyond_64_bits_are_an_error():
    rows = np.full((3, 2), 2.0**40)
    with pytest.raises(OverflowError):
        topk.search(topk.Tree(np.arange(3), rows), np.arange(1), rows[:1], 2, np.full(1, -np.inf))


def test_question_and_answer():
    assert decontamination.question_words("What is it? A dog.", 5) == 3
    assert decontamination.question_words("one two\nthree", 3) == 2
    assert decontamination.question_words("one two. three four", 4) == 2
    assert decontamination.question_words("one two three", 3) == 2


@pytest.mark.parametrize("text", ["a" * 50, "語" * 40, "ab " * 30 + "x" * 70 + " yz" * 20, "x" * 33 + " " + "x" * 33, " " * 80, "a b", "ñ" * 16 + ". ñ"])
def test_pieces_are_bounded_whatever_the_bytes(monkeypatch, text):
    """With pieces of 16 bytes and words of 32: no piece over that and its ends, all bytes in order, words cut from their start on only when too long."""
    whole = list(words.pieces(pa.array(["", text, None, "end"]), words.WORD_SEPARATORS))
    monkeypatch.setattr(words, "PIECE", 16)
    monkeypatch.setattr(words, "RUN", 32)
    parts = list(words.pieces(pa.array(["", text, None, "end"]), words.WORD_SEPARATORS))
    assert max(len(p.data) for p, _ in parts) <= 34
    texts = [np.concatenate([of for _, of in x]) for x in (whole, parts)]
    spans = [[bytes(p.data[a:b]) for p, _ in x for a, b in zip(p.starts, p.ends)] for x in (whole, parts)]
    want = [(i, w[k : k + 32]) for i, w in zip(texts[0], spans[0]) for k in range(0, len(w), 32)]
    assert [(i, w) for i, w in zip(texts[1], spans[1])] == want


def test_memory_of_a_long_text_without_separators():
    """The words of 24 MB of one letter, and of as much Han, stay within some times a piece."""
    for text in ("a" * (24 << 20), "語" * (8 << 20)):
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        n = sum(len(piece.words()) for piece, _ in words.pieces(pa.array([text]), words.WORD_SEPARATORS))
        peak = tracemalloc.get_traced_memory()[1] - before
        tracemalloc.stop()
        assert n == 12 and peak < 300 << 20

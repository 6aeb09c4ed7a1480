"""The tokenizer operators and spelling variants: brute force over whole tables, made texts, and odd tables."""

import gc
import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from statuta.llm import alignment, queries, sentencepieces, spelling
from tests.llm.test_operators import FOLDER, LARGER, ODD, none, odd, table  # noqa: F401

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SP = SentencePieceProcessor(model_file=B)
MARKS = ["a  b", " a", "a\nb\t c ", "", "  ", "a ", "▁x", "é Å ﬁ", "　x y", "a\x00b", "<s> </s> <0x41>", "<|endoftext|> x", "日本語😀", " " * 50, "x\n\ny \n z", "\n", "'s it'll", "\U0010ffff﻿"]
ALPHABETS = ["ab", "abcdefghij", "etaoinshrdlu", "aeiou \n", "▁ a", "=-_*", "ÀÉé àa", "0123456789", "日本語的一是", "😀𝒳ab", "' s'tll", "  \n\t a", " 　 x"]


def made(seed, size, each):
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(1, size))) for _ in range(20 * each)]
    return MARKS + mixed + ["".join(rng.choice(a) for _ in range(rng.randrange(1, size))) for _ in range(each) for a in ALPHABETS]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- pieces -------------------------------------------------------------------


@pytest.mark.parametrize("long", [0, 8, 10**9])
def test_merge_rounds_are_the_library_s(monkeypatch, long):
    """By rounds a word, in the order of ranks, and both by length."""
    monkeypatch.setattr(sentencepieces, "LONG", long)
    rng = random.Random(3)
    vocab = [SP.id_to_piece(i) for i in range(259, 28_000)]
    texts = made(1, 300, 40) + ["".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))).replace("▁", rng.choice(["", "▁", " "])) for _ in range(800)]
    pieces = sentencepieces.Pieces(B)
    ids, cuts = pieces.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == SP.encode(texts, add_eos=True)
    assert [x.decode() for x in pieces.decode(ids, cuts)] == [SP.decode(ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]


def test_decode_of_any_ids():
    rng = random.Random(4)
    rows = [[rng.choice([rng.randrange(300), rng.randrange(32_000)]) for _ in range(rng.randrange(12))] for _ in range(2000)] + [[], [2], [1, 28705, 28705, 2], [3 + 0xE3, 28705]]
    cuts = np.cumsum([0] + [len(r) for r in rows])
    got = sentencepieces.Pieces.of(B).decode(np.array([i for r in rows for i in r], np.int32), cuts)
    assert [x.decode() for x in got] == [SP.decode(r) for r in rows]


def test_one_long_word():
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdluabc") for _ in range(200_000))
    ids, _ = sentencepieces.Pieces.of(B).encode([text, "語" * 50_000])
    assert ids.tolist() == [i for x in SP.encode([text, "語" * 50_000], add_eos=True) for i in x]


def test_sentencepiece_brute_force(spark):
    docs = dict(table(spark, "documents", LARGER).select("doc_id", "text").collect())
    got = queries.QUERIES["op13_sentencepiece"](spark, LARGER).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = SP.encode(docs[r["doc_id"]] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(SP.decode(ids)))


def test_sentencepiece_odd(odd, none):  # noqa: F811
    got = sentencepieces.digest(odd, B).collect()
    want = [(r[0], SP.encode(r[1] or "", add_eos=True)) for r in ODD]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((k, len(i), sha(" ".join(map(str, i))), sha(SP.decode(i))) for k, i in want), key=key)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    back = sentencepieces.decode(sentencepieces.encode(odd, B), B).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(((r[0], r[1] or "") for r in ODD), key=key)
    assert sentencepieces.digest(none, B).collect() == [] and sentencepieces.decode(sentencepieces.encode(none, B), B).collect() == []


# ---- alignment ----------------------------------------------------------------

T = Tokenizer.from_file(A)
T.encode_special_tokens = True
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _SHOWN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
A_BYTES = {i: bytes(_BYTE[c] for c in k) for k, i in T.get_vocab().items() if all(c in _BYTE for c in k)}


def b_bytes(i):
    p = SP.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode()


def aligned(text):
    """A's ids, B's ids, groups as text, links: from whole texts and decoded bytes alone."""
    if not text:
        return None
    a, b = T.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    if not b"".join(A_BYTES[i] for i in a) == b"".join(map(b_bytes, b)) == (" " + text).encode():
        return None

    def ranges(ids, of):
        ends = np.cumsum([len(of(i)) for i in ids]).tolist()
        return list(zip(ids, [0, *ends], ends))

    ra, rb = ranges(a, A_BYTES.get), ranges(b, b_bytes)
    cuts = sorted({e for *_, e in ra} & {e for *_, e in rb})
    groups = [([], []) for _ in cuts]
    for side, r in enumerate((ra, rb)):
        for i, _, v in r:
            groups[bisect_left(cuts, v)][side].append(str(i))
    # a byte at a time: the tokens of both that hold it
    own_a, own_b = ([k for k, (_, u, v) in enumerate(r) for _ in range(u, v)] for r in (ra, rb))
    links = [(ra[i][0], rb[j][0]) for i, j in sorted(set(zip(own_a, own_b)))]
    return a, b, ";".join("|".join(map(",".join, g)) for g in groups), links


def test_alignment_of_made_texts():
    texts = made(6, 60, 40)
    for text, got in zip(texts, alignment.Aligner(A, B).align(texts)):
        want = aligned(text)
        assert (got is None) == (want is None), text
        if want:
            a, b, groups, links = want
            codes = np.frombuffer(got[4], np.int32).tolist()
            assert got[:4] == (groups, len(a), len(b), groups.count(";") + 1) and Counter(codes) == Counter(i * 32768 + j for i, j in links), text


class Counted:
    """A tokenizer that notes how many strings it was given."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def __getattr__(self, name):
        def call(texts, *args, **named):
            self.n += len(texts)
            return getattr(self.inner, name)(texts, *args, **named)

        return call


def test_alignment_puts_new_words_together(monkeypatch):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
    often = [word("abcdefgh") for _ in range(500)]
    texts = [" ".join([*often, *(word("abcdefghé") for _ in range(500))]) for _ in range(12)]
    aligner = alignment.Aligner(A, B)
    aligner.a, aligner.b = Counted(aligner.a), Counted(aligner.b)
    monkeypatch.setattr(alignment, "REMEMBERED", 2_000_000)
    met = set()
    for text in texts:
        before = aligner.a.n, len(aligner._units)
        (got,), want = aligner.align([text]), aligned(text)
        assert got[:3] == (want[2], len(want[0]), len(want[1]))
        # about 500 new words, given as a few runs of words; what came often is kept when memory is given back
        new = set(text.split(" ")) - met
        assert aligner.a.n - before[0] <= len(new) / 100 + 4 and aligner.b.n == aligner.a.n
        met |= new
    assert aligner._held < 2_000_000 and aligner._before[0] and len(aligner._units) < len(met)
    assert gc.isenabled()


def test_alignment_tells_lost_words_apart():
    words = [f"{'wé'[i % 2]}{chr(97 + i % 26)}{i}" for i in range(700)]
    words[300] = "▁x"  # not given back by B
    got = alignment.Aligner(A, B).align([" ".join(words), *words])
    assert [x is None for x in got] == [aligned(x) is None for x in [" ".join(words), *words]] and got[0] is None and got[1] is not None


def rows_by_brute_force(texts):
    """Digest rows in the order of ``texts``."""
    found = [aligned(x) for x in texts]
    n = Counter(link for w in found if w for link in set(w[3]))
    best = defaultdict(int)
    for (a, _), k in n.items():
        best[a] = max(best[a], k)
    out = []
    for w in found:
        if w is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = w
            out.append((len(a), len(b), groups.count(";") + 1, len(links), sum(n[x] == best[x[0]] for x in links), sum(n[x] for x in links), sha(groups)))
    return out


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 10])
def test_alignment_brute_force(spark, pairs):
    docs = table(spark, "documents")
    texts = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in alignment.align(docs, A, B, pairs=pairs).collect()}
    assert got == dict(zip((r["doc_id"] for r in texts), rows_by_brute_force([r["text"] for r in texts])))


def test_alignment_odd(spark, odd, none):  # noqa: F811
    short = odd.filter("doc_id is null or doc_id not in (6, 7)").unionByName(odd.limit(1).withColumn("text", F.lit("x▁y")).withColumn("doc_id", F.lit(50).cast("long")))
    texts = [(r[0], r[1]) for r in ODD if r[0] not in (6, 7)] + [(50, "x▁y")]
    got = alignment.align(short, A, B).collect()
    want = [(k, *row) for (k, _), row in zip(texts, rows_by_brute_force([t for _, t in texts]))]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["doc_id"], *(r[c] for c in FIELDS)) for r in got), key=key) == sorted(want, key=key)
    assert alignment.align(none, A, B).collect() == []
    whole = {r["doc_id"]: r for r in alignment.align(odd, A, B).collect()}
    assert whole[6]["n_a"] == len(T.encode(" " + next(t for k, t, *_ in ODD if k == 6), add_special_tokens=False).ids)


# ---- spelling -----------------------------------------------------------------


def spelled(rows, shortest=5, least=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= least}
    letters = set("".join(n))
    near = {w: [x for x in spelling.neighbours(w, letters) if x in n] if len(w) < 100 else [] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelled_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_brute_force(spark):
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    assert spelled_rows(queries.QUERIES["op12_spelling"](spark, FOLDER)) == spelled(rows)


@pytest.mark.parametrize("parts,alphabet", [(3, "ab"), (4, "abc"), (5, "abcdefghijklmé")])
def test_signatures_lose_no_pair(spark, parts, alphabet):
    rng = random.Random(parts)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"a" * 3000, "a" * 3001, "a" * 2999 + "b"})
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = {(r["word"], r["other"]) for r in spelling.near(counts, parts).collect()}
    short = {w for w in words if len(w) < 100}
    want = {(w, x) for w in short for x in spelling.neighbours(w, alphabet) & short}
    long = {("a" * 3000, "a" * 3001), ("a" * 3000, "a" * 2999 + "b")}
    assert got == want | long | {(y, x) for x, y in long}


def test_spelling_chains_and_ties(spark):
    names = ["abcde", "abcdf", "abcgf", "abhgf", "zzzzz", "zzzzy", "zzzzx"]
    text = " ".join(w for w, k in zip(names, (3, 6, 12, 24, 4, 8, 8)) for _ in range(k))
    # a key that lets no run of these lose a letter
    key = next(k for k in range(1000) if all(zlib.crc32(f"{k}:{w}".encode()) % 97 for w in names))
    got = spelled_rows(spelling.variants(spark.createDataFrame([(key, text)], "doc_id long, text string")))
    assert got["abcde"] == ("abcdf", "abhgf", 3, 1, 6) and got["abhgf"] == (None, "abhgf", 24, 1, None)
    assert got["zzzzz"] == ("zzzzx", "zzzzx", 4, 2, 8) and got["zzzzx"][:2] == (None, "zzzzx")


def test_spelling_odd(odd, none):  # noqa: F811
    assert spelled_rows(spelling.variants(odd)) == spelled([(r[0], r[1]) for r in ODD])
    assert spelling.variants(none).collect() == []

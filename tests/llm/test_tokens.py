import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelith.llm import spm, tokencount

MODEL = P.path("piece_bpe_32k.model")
ODD = ["", " ", "  Hello  world\n\tfoo  ﬁ ½ é é 　x ", "▁a", "      x\n\n     y          z", " " * 40 + "ab", "日本語 😀 def f(x):\n    return x==1 # ok..   !!", "\x00\x7f", "a" * 300, "." * 50, "https://a.b/?q=1&c=2"]


def test_encode_decode(docs, rows, odd, empty):
    ref = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    mine = spm.transducer(MODEL)
    for t in [*rows.values(), *ODD]:
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode(t)
        assert mine.decode(ids) == ref.decode(ref.encode(t))
    back = spm.decode(spm.encode(docs, MODEL), MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in back} == rows
    assert spm.report(docs, MODEL).where("not lossless").count() == 0
    assert spm.report(odd, MODEL).count() == odd.count() and spm.report(empty, MODEL).count() == 0


def test_neighbour_weights_are_those_of_merging():
    m = spm.transducer(MODEL)
    m.encode("The quick brown fox, jumping over 12 lazy dogs; naïvely so.")
    for a, b in [(a, b) for a, row in m.neighbours.items() for b in row if a is not None][:3000]:
        assert (m.weight(a, b) == 0) == (m.merged(a + b) == [a, b])


def test_the_shortest_path_is_the_least_of_all_paths():
    m = spm.transducer(MODEL)

    def every(text, i, known, far):
        if i == len(text):
            yield far, ()
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            if piece in m.scores and (j == i + 1 or m.merged(piece) == [piece]):
                own = -m.scores[piece]
            elif j == i + 1:
                own = m.byte_weight
            else:
                continue
            near = 0.0 if not i or m.merged(known + piece) == [known, piece] else float("inf")
            for total, rest in every(text, j, piece, far + own + near):
                yield total, (piece, *rest)

    for text in ["▁the", "▁naïve", "日本é", "▁▁▁x", "lower", "aaaaaa", "▁12,5", "x"]:
        paths = [p for p in every(text, 0, None, 0.0) if p[0] < float("inf")]
        total, found = m.shortest(text)
        assert len(paths) == 1 and min(paths) == (total, tuple(found))
    assert m.shortest("") == (0.0, [])


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_the_normaliser_is_its_rule(prefix, squeeze):
    class Bare(spm.Transducer):
        def __init__(self):
            self.normaliser = spm.normaliser(prefix, squeeze)
            self.loops = spm.loops(self.normaliser)

    for t in ODD + ["a", " a", "a ", "  a  b  ", "a\n b"]:
        want = re.sub(" +", " ", t.strip(" ")) if squeeze else t
        want = (" " * (prefix and bool(want)) + want).replace(" ", "▁")
        assert Bare().normalised(t, spm.START)[0] == want


def test_clashing_columns_and_long_texts(spark):
    long = ("ein sehr langer Text, " * 250_000)[:5_000_000]
    df = spark.createDataFrame([(1, "a b\nc", 7, "x"), (2, None, None, None), (3, long, 1, "y")], "doc_id long, text string, n_tokens int, section string")
    back = {r["doc_id"]: r["text"] for r in spm.decode(spm.encode(df, MODEL).selectExpr("doc_id", "ids", "1 as text"), MODEL).collect()}
    assert back == {1: "a b\nc", 2: "", 3: long}
    ids = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(long[:100_000])
    assert np.frombuffer(spm.transducer(MODEL).encode(long[:100_000]), "<u4").tolist() == ids
    got = tokencount.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 2, 2: 1, 3: 1}
    assert {r["doc_id"]: r["t"] for r in got}[3] == len(tokencount.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ends(long))


def test_token_spans(rows):
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = tokencount.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in list(rows.values())[:40] + ["é😀\nx", "日\n本", ""]:
        ends, chars = enc.ends(t), tokencount.char_starts(t.encode())
        ref = hf.encode(t, add_special_tokens=False)
        assert len(ends) == len(ref.ids)
        starts = np.array(tokencount.line_starts(t))
        if t.isascii():
            assert [int(np.searchsorted(chars, e)) for e in ends] == [b for _, b in ref.offsets]
        for rule in ("start", "end", "majority"):
            assert tokencount.attribute(ends, chars, starts, rule).sum() == len(ends)
        assert tokencount.attribute(ends, chars, starts, "share").sum() == pytest.approx(len(ends))


def test_rules():
    chars, starts = np.arange(11), np.array([0, 3, 6])
    ends = np.array([2, 7, 10])  # the second token holds 1, 3 and 1 characters of the three
    assert tokencount.attribute(ends, chars, starts, "start").tolist() == [2, 0, 1]
    assert tokencount.attribute(ends, chars, starts, "end").tolist() == [1, 0, 2]
    assert tokencount.attribute(ends, chars, starts, "majority").tolist() == [1, 1, 1]
    assert tokencount.attribute(ends, chars, starts, "share").tolist() == pytest.approx([1.2, 0.6, 1.2])


def brute(text, enc, rule):
    """Sections' tokens, character by character."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text) or [""]
    section_of = [k for k, line in enumerate(lines) for _ in line]
    first_byte, at = {}, 0
    for c, char in enumerate(text):
        first_byte[at] = c
        at += len(char.encode())
    out, at, char = [0.0] * len(lines), 0, -1
    for token in enc.encoding.encode_ordinary(text):
        size = len(enc.encoding.decode_single_token_bytes(token))
        own = [first_byte[b] for b in range(at, at + size) if b in first_byte]
        if at not in first_byte:  # it begins within a character, which it belongs with
            own = [char, *own]
        at, char = at + size, own[-1]
        where = [section_of[c] for c in own]
        if rule == "share":
            for k in where:
                out[k] += 1 / len(where)
        else:
            out[{"start": where[0], "end": where[-1], "majority": max(where, key=lambda k: (where.count(k), -k))}[rule]] += 1
    ends = np.cumsum([len(x) for x in lines]).tolist()
    return [(k, e - len(x), e, n) for k, (x, e, n) in enumerate(zip(lines, ends, out, strict=True))]


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_every_section_against_brute_force(spark, docs, odd, rule):
    enc = tokencount.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    crossing = spark.createDataFrame([(100, "a\n\n\n\nb", "s"), (101, "é😀\n日\n本\n\n  x", "s"), (102, "x.\n\n\n", "s"), (103, "\n", "s")], "doc_id long, text string, source string")
    for df in (docs.select("doc_id", "text"), odd.where("doc_id is not null and doc_id <> 5").select("doc_id", "text"), crossing.select("doc_id", "text")):
        got = {}
        for r in tokencount.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule).collect():
            got.setdefault(r["doc_id"], []).append((r["section"], r["char_start"], r["char_end"], r["n_tokens"]))
        for r in df.collect():
            want = brute(r["text"] or "", enc, rule)
            assert [x[:3] for x in sorted(got[r["doc_id"]])] == [x[:3] for x in want]
            assert [x[3] for x in sorted(got[r["doc_id"]])] == pytest.approx([x[3] for x in want])


def test_counts(docs, rows, odd, empty):
    enc = tokencount.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    out = tokencount.token_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r["doc_id"]: (r["n"], r["e"]) for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("char_end").alias("e")).collect()}
    assert got == {d: (len(enc.ends(t)), len(t)) for d, t in rows.items()}
    lines = sum(len(tokencount.line_starts(t)) for t in rows.values())
    assert out.count() == lines
    assert tokencount.token_counts(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "share").select("doc_id").count() >= odd.count()
    assert tokencount.token_counts(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0

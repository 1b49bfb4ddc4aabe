"""Alignment of two tokenizers against owners found byte by byte and counts over all link occurrences."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def pieces(tools, text):
    """[(id, bytes)] of both, or two empty lists."""
    a, b = tools
    if not text:
        return [], []
    one = a.encode(" " + text, add_special_tokens=False)
    decoder = alignment.byte_decoder()
    left = [(i, bytes(decoder[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    same = b"".join(x for _, x in left) == raw == b"".join(x for _, x in right)
    return (left, right) if same else ([], [])


def plain(tools, text):
    """(n_a, n_b, groups, links): groups by walking both sides; links are pairs of tokens that end together."""
    left, right = pieces(tools, text)
    ends = [[sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))] for side in (left, right)] if len(left) < 3000 else [list_ends(side) for side in (left, right)]
    place = {e: k for k, e in enumerate(ends[1])}
    links = [(left[k][0], right[place[e]][0]) for k, e in enumerate(ends[0]) if e in place]
    groups, i, j = [], 0, 0
    for k, e in enumerate(ends[0]):
        if e in place:
            groups.append(([t for t, _ in left[i : k + 1]], [t for t, _ in right[j : place[e] + 1]]))
            i, j = k + 1, place[e] + 1
    return len(left), len(right), groups, links


def list_ends(side):
    out, at = [], 0
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def said(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def expected(tools, rows):
    found = [(i, *plain(tools, t)) for i, t in rows]
    count = Counter(x for *_, links in found for x in links)
    most = {}
    for (a, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [(i, na, nb, len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), said(g)) for i, na, nb, g, links in found]


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_against_plain(spark, tools):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(queries.op13_alignment(spark, SF).select(*COLUMNS).collect(), expected(tools, rows))


TEXTS = ["", None, "a", " lead", "two  spaces", "tab\tand\nline", "naïve café", "中文字 mixed 𝒳 text", "<|endoftext|> and </s> <s> <unk> <0x41>", "▁ lower", "ﬁne ½ ①", "a b", "don't stop", "trailing ", "\x00\x01", "👩‍👩‍👧 family", "x" * 5000, "word " * 3000 + "end", "a", "a"]


@pytest.mark.parametrize("limit", [1 << 20, 8, 0])
def test_awkward_texts_at_any_split_of_pairs(spark, tools, limit):
    """All pairs sent to the tasks, a few of them, and none: the same rows."""
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, "odd") for r in rows], "doc_id int, text string, n_links string")
    same(alignment.align(docs, A, B, limit).select(*COLUMNS).collect(), expected(tools, rows))
    assert alignment.align(docs.limit(0), A, B, limit).count() == 0


def test_overlaps_and_cuts(spark, tools):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.alignments(docs, A, B).collect():
        left, right = pieces(tools, TEXTS[r.doc_id])
        owners = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (left, right)]
        pairs = list(dict.fromkeys(zip(*owners, strict=True)))
        assert list(zip(r.overlap_a, r.overlap_b, strict=True)) == pairs
        assert r.cuts == sorted(set(list_ends(left)) & set(list_ends(right)))
        assert (r.ids_a, r.ids_b) == ([i for i, _ in left], [i for i, _ in right])


def test_merge_ranks_give_the_tokenizer_s_ids(tools, tmp_path):
    """Every token alone is itself, and characters of every kind are cut alike; another kind of file has no ranks."""
    both = alignment.Tokenizers(A, B)
    assert all(both.ranked._core_bpe.encode_single_piece(x) == [i] for i, x in enumerate(both.bytes_a[:50256]))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 37 == 0)]
    texts = [f" a{c}a 1{c}1 !{c}! {c}  \t{c}\n" for c in chars]
    assert both.ids_a(texts) == [e.ids for e in tools[0].encode_batch_fast(texts, add_special_tokens=False)]
    assert alignment.ranked(public_tokenizers.path("word_bpe_49k.json")) is None
    said = json.load(open(A, encoding="utf-8"))
    merges = said["model"]["merges"]
    merges[10], merges[11] = merges[11], merges[10]
    (tmp_path / "other.json").write_text(json.dumps(said), encoding="utf-8")
    other = alignment.Tokenizers(str(tmp_path / "other.json"), B)
    assert other.ranked is None and len(other.ids_a(["a text"])[0]) > 0


def test_bytes_of_ids(tools):
    both = alignment.Tokenizers(A, B)
    assert both.bytes_a[tools[0].token_to_id("Ġthe")] == b" the" and len(both.names) == 4 * 50257

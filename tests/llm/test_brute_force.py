"""Every operator that SQL can't express against a plain version of itself."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, fingerprints, html_text, licenses, line_dedup, mixing, near_dedup, packing, quality, secrets

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# packing


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(PATH), packing.ChunkEncoder(PATH), random.Random(1)
    texts = ["<|startoftext|> HI <|EndOfText|> x<|endoftext|>y", "É'S don't we'Re 12a3 'sea !'s İstanbul ΣΑΣ ﬁ é ́x", "日本語 Ⅷ ½ ß ÿ Ÿ \x00\x01 a\x85b \x1c x", "", " \n"]
    texts += ["".join(rng.choice("aAzZéÉßñ'sStTrevmld0 9<|>!-\n\t.×ªλΣ́") for _ in range(60)) for _ in range(500)]
    want = [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert [encode(t) for t in texts] == want and list(packing.ChunkEncoder(PATH).many(texts)) == want


def test_every_token_alone_is_merged_into_itself():
    """What word_model() needs for ranks over bytes to give the tokenizer's merges."""
    from tokenizers import Tokenizer, models

    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    for end in (True, False):
        # Without word ends the merges of word ends never apply.
        own = Tokenizer(models.BPE(model["vocab"], merges, **({"end_of_word_suffix": "</w>"} if end else {})))
        tokens = [t for t in map("".join, merges) if t.endswith("</w>") == end]
        found = own.encode_batch_fast([[t[:-4] if end else t for t in tokens]], is_pretokenized=True, add_special_tokens=False)[0].ids
        assert found == [model["vocab"][t] for t in tokens]


# secrets


def test_ownership_decides_candidates(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("abcdefgXYZ0123") for _ in range(24)) + "aB1" for _ in range(40)]
    rows = [(i, " ".join(f"w{rng.randrange(9)} {rng.choice(values)}" for _ in range(rng.randrange(4))), f"o{rng.randrange(3)}", "en") for i in range(40)] + [(None, None, None, "en")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), F.struct("source", "lang"), F.col("source")).collect()
    owners = {}
    for _, text, owner, _ in rows:
        for v in re.findall(r"\S{20,}", text or ""):
            owners.setdefault(v, set()).add(owner)
    for r in got:
        text = next(t for d, t, _, _ in rows if d == r.doc_id) or ""
        own = list(re.finditer(r"\S{20,}", text))
        assert r.spans == ",".join(f"mixed:{m.start()}:{m.end()}" for m in own if len(owners[m[0]]) == 1)
        assert (r.n_copied, r.n_owner_specific) == (sum(len(owners[m[0]]) > 1 for m in own), sum(len(owners[m[0]]) == 1 for m in own))
    assert any(r.spans for r in got) and any(r.n_copied for r in got)


def test_base_secrets_of_the_sample(spark, documents):
    kinds = [
        ("assign", re.compile("(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 8),
        ("access", re.compile("(AKIA[A-Z0-9]+)"), 16),
        ("hex", re.compile("([0-9a-f]+)"), 32),
    ]
    rows = {r.doc_id: r.text for r in documents.collect()}
    for r in secrets.scan(documents, F.struct("source", "lang"), F.col("source")).collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, least) in enumerate(kinds) for m in p.finditer(rows[r.doc_id] or "") if len(m[1]) >= least)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


# mixing


def test_mixing_knows_no_layout(documents):
    rows = [sorted(map(str, mixing.mix(d).collect())) for d in (documents, documents.repartition(7), documents.orderBy(F.rand(3)).coalesce(1), documents.withColumn("extra", F.rand()))]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) == 200


def test_shards_draw_the_quotas(spark):
    quotas, size = [5000, 0, 1200, 37], 64
    whole = list(mixing.shard_counts(quotas, 0, 98, 5, size))
    assert [s for s, _, _ in whole] == list(range(98)) and sum(c for _, c, _ in whole).tolist() == quotas
    before = np.zeros(4, int)
    for shard, own, first in whole:
        assert first.tolist() == before.tolist() and own.sum() == min(size, sum(quotas) - shard * size)
        before += own
    assert [list(map(str, x)) for x in mixing.shard_counts(quotas, 40, 43, 5, size)] == [list(map(str, x)) for x in whole[40:43]]
    assert len({tuple(own) for _, own, _ in whole}) > 20  # drawn, not dealt in turn
    big = list(mixing.shard_counts([3 * 10**12, 10**12], 7, 8, 1, 10**10))[0]
    assert big[1].sum() == 10**10 and abs(big[1][0] / 10**10 - 0.75) < 0.01


def test_taken_words_against_the_slots(spark, documents):
    """taken, counted from the plan's slots and the order of documents by hand."""
    known, block = mixing.plan(documents, mixing.WEIGHTS, mixing.CAP, 64), 64
    rows = mixing.placed(known.sized, known).collect()
    drawn = {}
    for r in mixing.slots(spark, known.blocks, known.quotas, 7).collect():
        drawn[r.source_index, r.block] = drawn.get((r.source_index, r.block), 0) + 1
    want = sorted((r.doc_id, sum(drawn.get((r.source_index, w // block), 0) for w in range(r["_from"], r["_from"] + r["size"]))) for r in rows)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(documents).collect()) == want
    assert sorted((r.doc_id, r.taken) for r in mixing.shares(documents).collect()) == want
    for source in {r.source_index for r in rows}:
        spans = sorted((r["_from"], r["_from"] + r["size"]) for r in rows if r.source_index == source and r["size"])
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(spans))


# HTML


def plain_main(lines, surge):
    """Lines of the windows that reach `surge`, said plainly."""
    kept = set()
    for i in range(-2, len(lines)):
        at = [k for k in range(i, i + 3) if 0 <= k < len(lines)]
        if sum(lines[k] for k in at) >= surge:
            kept |= set(at)
    return [k in kept for k in range(len(lines))]


def test_surges_against_plain_windows():
    rng = random.Random(4)
    for _ in range(300):
        lines = [rng.choice((0, 0, 3, 30, 79, 80, 200)) for _ in range(rng.randrange(12))]
        assert html_text.surged(lines, 80) == plain_main(lines, 80)


PROSE = "The river rose in the night and the lower road was closed until the water fell again in the morning."
LAYOUTS = {
    "article": ("<body><nav><a href=1>Home</a></nav><article><h1>T</h1><p>{p}</p><p>End.</p></article><div class='comments'><p>Me too</p></div><footer>f</footer>", "T\n{p}\nEnd."),
    "plain divs": ("<div>Site name</div><div><a href=1>Home</a> <a href=2>About</a></div><div><h1>T</h1><p>{p}</p><p>Short.</p><p>{p}</p></div><div>Copyright 2020</div>", "T\n{p}\nShort.\n{p}"),
    "form around the page": ("<form><div><p>{p}</p></div></form>", "{p}"),
    "form around the article": ("<nav>n</nav><form><article><p>{p}</p></article></form>", "{p}"),
    "names that only look alike": ("<div class='side-by-side'><p>{p}</p><h2 id='related-work'>Rel</h2><p id=side-effects>{p}</p></div>", "{p}\nRel\n{p}"),
    "inline names": ("<article><p>One <span class=share>share price</span> rose.</p><p><a href=x>closing link</a></p></article>", "One share price rose.\nclosing link"),
    "compound names": ("<div class='cookie-notice top'>We use cookies</div><main><p>{p}</p></main><div id=site-footer>{p}</div>", "{p}"),
    "links in a row": ("<main><p>{p}</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></main>", "{p}"),
    "short page": ("<p>Only this.</p>", "Only this."),
    "no end tags": ("<html><head><title>t</title><body><p>{p}<p>{p}<script>x</script><ul><li>a<li>b</ul>", "{p}\n{p}\na\nb"),
    "comments and raw text": ("<!-- <p>no</p> --><p>{p}</p><style>p{{}}</style><![CDATA[no]]><svg><p>no</p></svg><p>1 < 2 &amp; 3</p>", "{p}\n1 < 2 & 3"),
}


LONG = "The council met on Tuesday evening to talk over the plan for the bridge, and most who came to hear it stayed to the end of the debate."
SHORT = ("It rained.", "Few had cars.", "They walked.", "All got home.")
LAYOUTS |= {
    "a div per paragraph": (f"<div>{SHORT[0]}</div><div>{SHORT[1]}</div><div>{LONG}</div><div>{SHORT[2]}</div><div>{SHORT[3]}</div>", "\n".join([*SHORT[:2], LONG, *SHORT[2:]])),
    "many short divs between long ones": ("<div><div>{p}</div>" + "<div>Yes.</div>" * 9 + "<div>{p}</div></div>", "\n".join(["{p}"] + ["Yes."] * 9 + ["{p}"])),
    "a title in a div of its own": (f"<div>A title</div><div>{LONG}</div>", f"A title\n{LONG}"),
    "a heading in another container": (f"<div>Site</div><div><h1>A title</h1></div><div><p>{LONG}</p><p>End.</p></div>", f"A title\n{LONG}\nEnd."),
    "a widget around the text": (f"<div>Menu</div><div class='widget article-body'><p>{LONG}</p><p>End.</p></div>", f"{LONG}\nEnd."),
    "a post to share": (f"<div class='post share'><p>{LONG}</p></div>", LONG),
    "loose names in an article": (f"<article><p>{LONG}</p><div class='row social'>{LONG}</div><div class='social share'>Share this</div><section id='comment'><p>{LONG}</p></section></article>", f"{LONG}\n{LONG}\n{LONG}"),
    "linked sources": (f"<article><p>{LONG}</p><ul><li><a>Source 1</a><li><a>Source 2</a><li><a>Source 3</a></ul></article>", f"{LONG}\nSource 1\nSource 2\nSource 3"),
    "reader comments": (f"<article><p>{LONG}</p><div id='reader-comments'><p>{LONG}</p></div><ol class='commentlist'><li>{LONG}</ol></article><div class='comment-list'>{LONG}</div>", LONG),
    "adverts by part of a name": (f"<article><p>{LONG}</p><div class='ad-slot-300x250'>{LONG}</div><div id='ad2'>Buy</div></article>", LONG),
    "a layout table": (f"<table><tr><td>Home<br>News<br>About</td><td><p>{LONG}</p><p>Then.</p><p>{LONG}</p></td></tr></table>", f"{LONG}\nThen.\n{LONG}"),
    "deep inline nesting": ("<article>" + "<span><a><b>" * 12 + LONG + "</b></a></span>" * 12 + "<p>End.</p></article>", f"{LONG}\nEnd."),
    "only names": ("<div class='sidebar'>Only this.</div>", "Only this."),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_text.main_text(page.format(p=PROSE)) == want.format(p=PROSE)


def test_the_distribution_decides_where_names_are_silent():
    page = "<div>Small print here</div><div><p>{p}</p></div><div>Tiny</div>".format(p=PROSE)
    assert html_text.main_text(page) == PROSE
    assert "Small print here" in [line.text for line in html_text.lines_of(page)]


@pytest.mark.parametrize("piece", ['<a x="', "<![CDATA[", "<div>", "<svg>", "<b><div></b>", "<p>x<!--", "<form><article>x", "<div class=share><p>" + "x" * 90, "<a href=y>z", "<span hidden></b>", "&amp;", "<"])
def test_long_pages_take_time_in_proportion(piece):
    began = time.process_time()
    html_text.main_text(piece * 20_000)
    assert time.process_time() - began < 3


def test_extract_rows(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (2, None, "<p>Again.</p>", "y"), (2, None, "<p>Again.</p>", "y"), (None, "u", "<article><p>é</p></article>", "z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [(1, "u", "", 0), (2, "u", "", 0), (2, None, "Again.", 6), (2, None, "Again.", 6), (None, "u", "é", 1)])) or [tuple(r) for r in got].count((2, None, "Again.", 6)) == 2
    assert {tuple(r) for r in got} == {(1, "u", "", 0), (2, "u", "", 0), (2, None, "Again.", 6), (None, "u", "é", 1)}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# exact dedup


def test_batches_through_a_kept_index(spark):
    rows = [(i, random.Random(i % 7).choice(["A b", "a B", "c", "", None, "d e"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, t in rows:
        want.setdefault((t or "").lower(), []).append(d)
    for batches in (1, 2, 3):
        got = exact_dedup.dedup(docs, batches=batches).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {d: (max(want[(t or "").lower()]), len(want[(t or "").lower()]), d == max(want[(t or "").lower()])) for d, t in rows}
    index = exact_dedup.DigestIndex(spark, "kept_digests", 4)
    exact_dedup.dedup(docs.filter("doc_id >= 30"), index).count()
    second = {r.doc_id: r for r in exact_dedup.dedup(docs.filter("doc_id < 30"), index).collect()}
    assert len(second) == 30 and all(r.keep_id == max(want[(rows[d][1] or "").lower()]) and r.group_size == len(want[(rows[d][1] or "").lower()]) for d, r in second.items())
    assert sum(r.kept for r in index.read().join(exact_dedup.digests(docs), "text_sha256").selectExpr("doc_id = keep_id as kept").collect()) == len(want)


# near dedup


@pytest.mark.parametrize("n, exact", [(300, False), (300, True)])
def test_form_letters_meet_no_more_than_they_must(spark, monkeypatch, n, exact):
    """Much shared, nearly nothing linked, lists of hundreds: results by brute force, candidates far below all pairs."""
    met, estimated, rng = [], near_dedup.estimated, random.Random(5)
    monkeypatch.setattr(near_dedup, "estimated", lambda pairs, sketches: met.append(pairs.count()) or estimated(pairs, sketches))
    fixed = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(12)]
    filled = [[" ".join(f"f{k}x{j}y{i}" for i in range(8)) for j in range(6)] for k in range(12)]
    letters = [[rng.randrange(6) for _ in range(12)] for _ in range(n - 40)]
    letters += [[*a[:5], (a[5] + 1) % 6, *a[6:]] for a in letters[:40]]  # one filling changed: linked
    texts = [" ".join(fixed[k] + " " + filled[k][j] for k, j in enumerate(a)) for a in letters]
    sets = [frozenset(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    parent = list(range(n))
    for i in range(n):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                lo, hi = sorted((parent[i], parent[j]))
                parent = [lo if p == hi else p for p in parent]
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), exact).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(parent)) and len(set(parent)) < n
    assert exact or sum(met) < 0.7 * n * (n - 1) / 2


def test_bands_grow_slower_than_the_crowd():
    shapes = [near_dedup.band_shape(n) for n in (300, 600, 1200, 10**6)]
    assert all((1 - 0.85**w) ** b <= 1.01e-6 for w, b in shapes) and shapes[2][1] < 2 * shapes[0][1]


# lines


def plain_lines(texts: dict) -> dict:
    first, out = {}, {}
    order = sorted(texts, key=lambda d: d)
    for d in order:
        lines = (texts[d] or "").split("\n")
        for at in range(len(lines) - 2):
            first.setdefault(tuple(lines[at : at + 3]), (d, at))
    for d in order:
        lines, gone = (texts[d] or "").split("\n"), set()
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if any(x.strip(" ") for x in w) and first[w] != (d, at):
                gone |= {at, at + 1, at + 2}
        out[d] = (texts[d] if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_line_dedup_against_brute_force(spark, documents):
    rng = random.Random(7)
    texts = {r.doc_id: r.text for r in documents.collect()}
    texts |= {10**6 + i: "\n".join(rng.choice(["a", "b", "", " ", "c d"]) for _ in range(rng.randrange(12))) for i in range(60)}
    texts[2 * 10**6] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()} == plain_lines(texts)


# licences


def test_base_phrases_and_labels_of_the_sample(documents):
    scan = licenses.Scanner()
    for r in documents.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        n, base, first, last, labels, _ = scan.find(r.text or "")
        assert (n, base, first, last, labels) == (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_matching_statistics_against_brute_force():
    """At each word, the places of the longest run that any template holds, where they can't be continued."""
    rng = random.Random(2)
    for _ in range(30):
        sequences = [[rng.choice("abc") for _ in range(rng.randrange(4, 12))] for _ in range(3)]
        words, want = [rng.choice("abc") for _ in range(25)], set()
        for i in range(1, 26):
            runs = {}
            for k, s in enumerate(sequences):
                for e in range(1, len(s) + 1):
                    runs[k, e] = next((n for n in range(min(e, i)) if s[e - 1 - n] != words[i - 1 - n]), min(e, i))
            longest = max(runs.values())
            want |= {(i, n, k, e) for (k, e), n in runs.items() if n == longest >= 3 and not (e < len(sequences[k]) and i < 25 and sequences[k][e] == words[i])}
        automaton = licenses.SuffixAutomaton(sequences)
        assert {(start + n, n, k, e) for start, n, places in automaton.matches(words, 3) for k, e in places} == want


def plain_best(found):
    """The most that any chain covers, by trying all."""
    found, most = sorted(found), 0

    def go(j, covered):
        nonlocal most
        most = max(most, covered)
        s, n, p = found[j]
        for i in range(j + 1, len(found)):
            t, m, q = found[i]
            own = m - max(0, s + n - t, p + n - q)
            if s < t and p < q and own > 0 and t - (s + n) <= licenses.GAP:
                go(i, covered + own)

    for j in range(len(found)):
        go(j, found[j][1])
    return most


def test_chains_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        found = list({(rng.randrange(40), rng.randrange(1, 8), rng.randrange(30)) for _ in range(rng.randrange(1, 9))})
        chains = licenses.best_chains(found)
        assert max(c for _, _, c in chains) == plain_best(found)
        spans = sorted(c[:2] for c in chains)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))


def test_a_false_start_is_skipped():
    scan = licenses.Scanner()
    words = scan.names[0][1]
    assert scan.find(" ".join(words[:20] + words[5:9] + words[20:]))[-1] == [("mit", 0, 0, len(words) + 4, 1.0)]


@pytest.mark.parametrize("label", licenses.TEMPLATES)
def test_every_template_is_found(label):
    scan = licenses.Scanner()
    for text in licenses.TEMPLATES[label]:
        assert label in scan("Before it. " + text.upper() + " After it.")[-2].split(",")


# fingerprints


def test_fingerprints_against_brute_force(spark):
    rows = [(i if i % 3 else None, f"the cat{i} sat on the mat{i % 7} and the dog{i} ran to the park{i} " * (1 + i % 5)) for i in range(90)] + [(7, "x y z"), (7, "a the b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is None, -(hashes[r[1]] if r[0] is None else r[0]), r[1]))
    want = []
    for i, (d, text) in enumerate(order):
        after, k = order[(i + 1) % len(order)][1], len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, b, c = map(fingerprints.signatures, (text, edited, after))
        alike = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.written(a), fingerprints.written(b), *alike))
    for size in (64 << 20, 500):
        assert sorted(map(str, map(tuple, fingerprints.fingerprint(docs, size).collect()))) == sorted(map(str, want))


# quality


def test_votes_against_plain_cosines(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(documents, labels)
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    known = sorted((r.doc_id, r.quality) for r in labels.filter("quality is not null").collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    assert len(model.y) == len(known) and model.y.tolist() == [q for _, q in known]
    for r in quality.classify(documents, labels).limit(40).collect():
        own = model.project(quality.features(texts[r.doc_id])[None])[0]
        near = [(float(own @ v), y) for v, y in zip(model.labelled, model.y, strict=True)]
        top = sorted(near, key=lambda x: -x[0])[: quality.NEIGHBOURS]
        weights = [max(s, 1e-3) ** quality.POWER for s, _ in top]
        assert abs(r.score - sum(w * y for w, (_, y) in zip(weights, top, strict=True)) / sum(weights)) < 1e-3
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7)


def test_features_of_long_texts_come_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choice(["One", "two,", "three\nfour", "é!"]) for _ in range(5000)) + "x" * 900
    whole = quality.features(text)
    monkeypatch.setattr(quality, "BLOCK", 97)
    assert np.allclose(quality.features(text), whole, atol=1e-6)


def test_repeated_labelled_rows_reach_the_driver_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(i, f"Some words {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    assert len(quality.fit(docs, labels).y) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1, 30))

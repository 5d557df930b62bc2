"""The training-data operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kestrel.llm import ann, html_text, language, near_dup, packing, token_files, toxicity
from kestrel.llm import registry as queries
from kestrel.llm.bpe import decode_documents, encode_documents, load_bpe, round_trip_digests
from kestrel.llm.common import words_of
from kestrel.llm.threshold_search import threshold_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, extra string, lang string"
ODD = [(1, None, "x", "en"), (2, "", None, None), (3, "   \t\n", "x", "en"), (4, "word", "x", "en"), (5, "Ünïcode  Straße ﬁ x", None, "de"),
       (6, "a<|endoftext|>b it's 12 ½ 日本語", "x", None), (7, "the cat sat on the mat " * 400, "x", "en"), (8, "the cat sat on the mat " * 400, "x", "en"),
       (9, "x" * 5000, None, "en"), (None, "no id here", "x", "en"), (4, "word", "x", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary())


# -- tokens -----------------------------------------------------------------------------------

def test_bpe_equals_library_on_odd_texts(library):
    rng = np.random.default_rng(5)
    texts = [t or "" for _, t, _, _ in ODD] + ["aaaa" * 200, "\x00\x1cq\x85z", "Σίσυφος ΣΑΣ İı ǅ", "😀👍🏽!!!??", "<|ENDOFTEXT|><|startoftext|>"]
    texts += ["".join(chr(c) for c in rng.integers(32, 800, 60)) for _ in range(40)]
    texts += ["".join("abinthe'sDON.,!  \n"[c] for c in rng.integers(0, 18, 200)) for _ in range(40)]
    ids, starts = load_bpe(queries.vocabulary()).encode_texts(pa.array(texts))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[starts[i]: starts[i + 1]].tolist() == e.ids, texts[i]


def test_bpe_pair_check_equals_exact_merging():
    bpe = load_bpe(queries.vocabulary())
    rng = np.random.default_rng(1)
    inner = np.nonzero(bpe.stable & np.array([0 < len(s) and not s.endswith("</w>") for s in bpe.strings]))[0]
    last = np.nonzero(bpe.stable & np.array([s.endswith("</w>") for s in bpe.strings]))[0]
    a, b = rng.choice(inner, 3000), rng.choice(last, 3000)
    ok = bpe.compatible(a, b)
    raw, at = [], [0]
    for x, y in zip(a, b):
        raw.append(bpe._bytes(bpe.strings[x])[0] + bpe._bytes(bpe.strings[y])[0])
        at.append(at[-1] + len(raw[-1]))
    flat, starts = bpe._exact(np.frombuffer(b"".join(raw), np.uint8), np.array(at), np.arange(len(a)))
    same = [flat[starts[i]: starts[i + 1]].tolist() == [a[i], b[i]] for i in range(len(a))]
    assert ok.tolist() == same and 0 < sum(same) < len(same)


def test_bpe_documents_round_trip(spark, odd, empty, library):
    encoded = encode_documents(odd, queries.vocabulary())
    texts = sorted((r["text"] for r in decode_documents(encoded, queries.vocabulary()).collect()))
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in ODD]
    assert texts == sorted(library.decode(i, skip_special_tokens=False) for i in want)
    digests = round_trip_digests(odd, queries.vocabulary()).collect()
    assert sorted(r["ids_sha256"] for r in digests) == sorted(hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in want)
    assert round_trip_digests(empty, queries.vocabulary()).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    counts = np.zeros(1 << 16, np.int64)
    counts[:3000] = np.maximum(1, (1e7 / np.arange(1, 3001) ** 2)).astype(int)
    counts[rng.integers(3000, 60000, 500)] = 1
    lengths = token_files.code_lengths(counts)
    assert lengths.max() <= 16 and (lengths[counts > 0] > 0).all() and not lengths[counts == 0].any()
    assert sum(2.0 ** -int(x) for x in lengths[counts > 0]) == 1.0
    flat = rng.choice(np.nonzero(counts)[0], 5000).astype(np.uint16)
    starts = np.array([0, 0, 1, 700, 700, 5000])
    payload, at, marks, mark_at = token_files.huffman_pack(flat, starts, lengths, token_files.canonical_codes(lengths))
    symbol, size = token_files.decode_table(lengths)
    for i in range(5):
        n = starts[i + 1] - starts[i]
        own = marks[mark_at[i]: mark_at[i + 1]]
        runs = np.minimum(token_files.CHECKPOINT, n - token_files.CHECKPOINT * np.arange(len(own)))
        got = token_files.huffman_unpack(payload[at[i]: at[i + 1]], own, runs, symbol, size)
        assert got.tolist() == flat[starts[i]: starts[i + 1]].tolist()


def test_token_files_round_trip(odd, empty, library):
    rows = token_files.write_and_read(odd, queries.vocabulary(), end_id=1, emit="ids").collect()
    assert len(rows) == len(ODD)
    by_start = sorted(rows, key=lambda r: r["start"])
    at = 0
    for r in by_start:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in by_start] == [None, *sorted(d for d, *_ in ODD if d is not None)]
    want = sorted((d or 0, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in ODD)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in rows) == want
    assert token_files.write_and_read(empty, queries.vocabulary(), end_id=1).count() == 0


def test_hilbert_neighbours_and_packing(odd, empty, library):
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()
    rows = packing.pack_documents(odd, queries.vocabulary(), end_id=2, length=64).collect()
    pieces = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 64 - r["offset"]
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, own in pieces.items():
        ends = [o + n for o, n in sorted(own)]
        assert [0, *ends[:-1]] == [o for o, _ in sorted(own)] and (ends[-1] == 64 or s == max(pieces))
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ODD)
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        whole[r["doc_id"]] += r["ids"]
    assert whole[7] == library.encode(ODD[6][1], add_special_tokens=False).ids + [2] == whole[8]
    assert packing.pack_documents(empty, queries.vocabulary()).count() == 0


# -- near duplicates --------------------------------------------------------------------------

def _components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    word = lambda: "w" + str(rng.integers(0, 4000))
    rows = [(i, " ".join(word() for _ in range(rng.integers(1, 60)))) for i in range(200)]
    base = [word() for _ in range(90)]
    for i in range(200, 360):       # one group of near copies, many too far apart to be linked
        copy = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 16)):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    rows += [(400 + i, rows[i][1].upper()) for i in range(30)] + [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, " one ")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, label string").repartition(3)
    for width, percent in ((2, 80), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, width, percent).collect()}
        assert got == _components(rows, width, percent)


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_dup.near_duplicates(odd, 2, 80).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["component_id"] == 7 and not by[8]["kept"] and by[7]["kept"]
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[None]["kept"]
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_representatives(odd, 2, 80)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9]


# -- classifiers ------------------------------------------------------------------------------

def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    grid, trans = rng.normal(size=(1, 6)).astype(np.float32), rng.normal(size=(2, 2))
    p, moves = toxicity.forward_backward(grid, np.ones((1, 6), bool), trans)
    total, want, pairs = 0.0, np.zeros(6), np.zeros((2, 2))
    for code in range(64):
        y = [(code >> k) & 1 for k in range(6)]
        w = np.exp(sum(grid[0, k] * y[k] for k in range(6)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        want += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    assert np.allclose(p[0], want / total, atol=1e-5) and np.allclose(moves, pairs / total, atol=1e-5)


def test_chain_over_rows_equals_one_pass():
    rng = np.random.default_rng(6)
    lens = [1, 64, 0, 65, 128, 129, 700, 3, 200]
    starts = np.concatenate([[0], np.cumsum(lens)])
    e, trans = rng.normal(-0.5, 2, starts[-1]).astype(np.float32), np.array([[1.0, -2.0], [-1.5, 2.5]])
    got = toxicity.Chain(np.zeros(0, np.uint64), np.zeros(0, np.float32), 0.0, trans).marginals(e, starts)
    grid, cell, head = toxicity._runs(e, starts)
    moves = toxicity.chained(grid, np.isfinite(grid), trans, head)[1]
    total = np.zeros((2, 2))
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            want, m = toxicity.forward_backward(e[None, a:b], np.ones((1, b - a), bool), trans)
            assert np.allclose(got[a:b], want[0], atol=1e-6)
            total += m
    assert np.allclose(moves, total, rtol=1e-6)


def test_toxicity_sample_and_blocks(monkeypatch):
    assert (toxicity.TOXIC_DOCS, toxicity.CLEAN_DOCS) == (1500, 3000)
    assert toxicity.fit_chain.__defaults__ == (60,)
    rng = np.random.default_rng(9)
    toxic = np.arange(120) % 4 == 0
    texts = pa.array([" ".join([f"w{x}" for x in rng.integers(0, 300, 90)] + ["vileword"] * int(t) + ["tail"]) for t in toxic])
    whole = toxicity.fit_chain(texts, toxic)
    monkeypatch.setattr(toxicity, "BLOCK_TOKENS", 500)
    parts = toxicity.fit_chain(texts, toxic)
    assert len(whole.keys) and np.array_equal(whole.keys, parts.keys)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.trans, parts.trans, atol=1e-4)


def test_toxicity_finds_spans_and_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(4)
    plain = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), n), rng.integers(0, 400, n))]
    texts, labels = [], []
    for i in range(300):
        w, bad = plain(40), i % 4 == 0
        if bad:
            for k in rng.integers(0, 40, 3):
                w[k] = str(rng.choice(["vileword", "nastyone", "foulish"]))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 5 == 0
    rows = toxicity.score_toxicity(docs, marks, ~held, spans=True).where(held).collect()
    toxic = {i: t for i, _, t in labels}
    assert all((r["score"] >= 0.3) == bool(toxic[r["doc_id"]]) for r in rows)
    text = dict(texts)
    for r in rows:
        for s in r["spans"]:
            assert text[r["doc_id"]][s["start"]: s["end"]] in ("vileword", "nastyone", "foulish")
    chain = toxicity.train(docs, marks, ~held)
    assert {r["doc_id"]: r["score"] for r in toxicity.tag_documents(odd, chain).collect()}[1] == 0.0
    assert toxicity.drop_toxic(odd, chain, 0.3).count() == len(ODD)
    assert toxicity.score_toxicity(empty, marks, ~held).count() == 0
    nothing = toxicity.score_toxicity(docs, marks.limit(0), ~held)
    assert nothing.agg(F.max("score")).first()[0] == 0.0


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= 8      # of 14; the others share no marker with the learnt rows


def test_language_hierarchy(spark, odd, empty):
    rows = queries.op5_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    model = language.train(odd, F.lit(True))
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(odd, model).collect()]
    assert [p for i, p in got if i in (1, 2, 3)] == ["und"] * 3 and all(p in ("en", "de") for i, p in got if i not in (1, 2, 3))
    assert language.keep_identified(odd, model).count() == len(ODD) - 3
    assert language.identify_language(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


# -- pages ------------------------------------------------------------------------------------

def test_tree_marginals_equal_enumeration():
    forest = html_text.Forest()
    html_text.add_page(forest, "<div><p>a</p><p>b<b>c</b></p></div>")
    tree = html_text.Tree(forest)
    rng = np.random.default_rng(8)
    unary, edge = rng.normal(size=tree.size), rng.normal(size=(2, 2))
    p, pairs = tree.marginals(unary, edge)
    total, want, moves = 0.0, np.zeros(tree.size), np.zeros((2, 2))
    for code in range(1 << tree.size):
        y = np.array([(code >> k) & 1 for k in range(tree.size)])
        links = [(y[tree.parent[c]], y[c]) for c in range(tree.size) if tree.parent[c] >= 0]
        w = np.exp((unary * y).sum() + sum(edge[a, b] for a, b in links))
        total += w
        want += w * y
        for a, b in links:
            moves[a, b] += w
    assert np.allclose(p, want / total) and np.allclose(pairs, moves / total)


@pytest.fixture(scope="module")
def content_model():
    return html_text.train(html_text.labelled_pages())


def test_html_layouts(content_model):
    pages = [
        None, "", "plain", "<article><p>a &amp; b&nbsp;c<p>d<br>e</article><footer>no</footer>",
        "<body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy now</div><article><h1>T</h1><p><b>One <i>two</i><br><p>Three"
        "<script>var t='</p>'</script><div class=comments><p>I disagree with all of it.</p></div></article><footer>c</footer><a hre",
        "<main><h1>Head</h1>" + "<p>some words in a paragraph of the text</p>" * 3 + "<aside>Related</aside><form>Mail <button>Go</button></form></main>",
        "<div>" * 3000 + "deep",
    ]
    texts = content_model.main_texts(pages)
    assert texts[:2] == ["", ""]
    assert texts[3] == "a & b c d e"
    assert texts[4] == "T One two Three"
    assert texts[5] == "Head " + " ".join(["some words in a paragraph of the text"] * 3)
    held = html_text.labelled_pages(60, seed=123)
    forest = html_text.Forest()
    for p in held:
        html_text.add_page(forest, p)
    tree = html_text.Tree(forest)
    p = tree.marginals(tree.unary(content_model.weights), content_model.edge)[0]
    own = np.array(forest.own) > 0
    assert ((p > 0.5) == np.array(forest.label))[own].mean() > 0.97


def test_html_embedded_elements_keep_the_text_around(content_model):
    first, last = "some words of the first paragraph here", "the second paragraph comes after it"
    inside = {
        "<svg class='i'/>": "", "<math/>": "", "<object>": "", "<select>": "", "<template>": "", "<svg><path d='M0'>": "", "<svg><title/></svg>": "",
        "<select><option>blue<option>red": "", "<select><option>red</option></select>": "", "<svg><svg><title>icon</title></svg><path/></svg>": "",
        "<object><object>in</object> more</object>": "in more", "<template><template><p>no</p></template><p>not</p></template>": "",
        "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is</p>": "so x=2 is", "<object><p>seen text here</p></object>": "seen text here",
        "<object-card>card</object-card>": "card", "<title-bar>bar</title-bar>": "bar", "<style-guide>g</style-guide>": "g", "<select-menu>m</select-menu>": "m",
        "<svg><style>a>b{}</style><text>label</text></svg>": "label", "<script>var a='<p>x</p>'</script >": "", "<textarea>x</textarea>": "",
    }
    pages = [f"<body><nav><ul><li><a href=x>Home</a></ul></nav><article><p>{first}</p>{x}<p>{last}</p></article><footer>foot</footer>" for x in inside]
    assert content_model.main_texts(pages) == [" ".join(f"{first} {w} {last}".split()) for w in inside.values()]


def test_html_query_on_pages(spark):
    import html as h
    got = {r["page_id"]: r for r in queries.op1_html_text(spark, SF001).collect()}
    for r in spark.read.parquet(f"{SF001}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    empty = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3)], "page_id long, url string, html string, text int")
    assert [r["text"] for r in html_text.extract_main_text(empty).collect()] == ["", ""]
    assert html_text.extract_main_text(empty.limit(0)).count() == 0


# -- language model ---------------------------------------------------------------------------

def test_lm_base_scores_and_model(spark, odd, empty):
    from kestrel.llm.lm import score_documents
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = score_documents(docs, queries.held_out(7)).collect()
    counts, tokens = defaultdict(int), {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))) + [None]
        tokens[r["doc_id"]] = w
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            for x in w:
                counts[x] += 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(w) and r["n_known"] == sum(counts.get(x, 0) > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    got = score_documents(odd, queries.held_out(7)).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert score_documents(empty, queries.held_out(7)).count() == 0
    assert all(np.isfinite(r["score"]) for r in score_documents(odd, F.lit(True)).collect())


def test_lm_factors_are_a_distribution():
    from kestrel.llm import lm
    rng = np.random.default_rng(0)
    w = lm.Weights.from_flat(rng.normal(size=lm.Weights.from_flat(np.zeros(2_000_000)).flat().size))
    total = sum(10 ** lm.log10_slots(w, np.array([5, 9, s]), np.array([0, 3]))[2] for s in range(lm.SLOTS))
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_text_score_by_hand():
    """Every token's probability against a plain loop over its features, for texts of several lengths."""
    from kestrel.llm import lm
    rng = np.random.default_rng(3)
    w = lm.Weights.from_flat(rng.normal(size=lm.Weights.from_flat(np.zeros(2_000_000)).flat().size))
    codes = rng.integers(0, lm.SLOTS, 40) + lm.SLOTS * rng.integers(0, 50, 40)
    starts = np.array([0, 1, 3, 20, 40])
    wide, narrow = lm.features(w, codes, starts)
    got = lm.log10_slots(w, codes, starts)
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    for i, code in enumerate(codes):
        cls, place = code % lm.SLOTS % lm.CLASSES, code % lm.SLOTS // lm.CLASSES
        of_class = softmax(sum(w.a[r].astype(float) for r in wide[i]) + w.a0)
        in_class = softmax(sum(w.b[r * lm.CLASSES + cls].astype(float) for r in narrow[i]) + w.b0[cls])
        assert got[i] == pytest.approx(np.log10(of_class[cls]) + np.log10(in_class[place]), abs=1e-4)
    # A history is the text's own: each text alone gives the same.
    for a, b in zip(starts[:-1], starts[1:]):
        assert np.allclose(lm.log10_slots(w, codes[a:b], np.array([0, b - a])), got[a:b])


def test_lm_marked_words_tell_histories_apart():
    from kestrel.llm import lm
    w = lm.Weights.from_flat(np.zeros(lm.WIDE * 32 + 32 + lm.NARROW * 1024 + 1024))
    tail = lm.END + 7
    wide, _ = lm.features(w, np.array([tail + lm.SLOTS * 5, 3, tail + lm.SLOTS * 6, 3]), np.array([0, 2, 4]))
    assert (wide[1] != wide[3]).any()
    sizes = [lm.table_rows(n) for n in (0, 4096, 10**5, 10**6, 10**8)]
    assert sizes[0] == sizes[1] == (lm.WIDE, lm.NARROW) and sizes == sorted(sizes) and sizes[-1][0] > 100 * lm.WIDE


def test_lm_scores_do_not_depend_on_the_split(spark, monkeypatch):
    """Many shards, so that updates are summed over two levels; rows in other partitions and order, repeated rows."""
    from kestrel.llm import lm
    monkeypatch.setattr(lm, "SHARD_TOKENS", 60)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    docs = docs.union(docs.where("doc_id % 5 = 0"))
    scores = [sorted((r["doc_id"], r["score"]) for r in lm.score_documents(d, queries.held_out(7)).collect())
              for d in (docs.coalesce(1), docs.repartition(5).orderBy(F.desc("doc_id")))]
    assert scores[0] == scores[1] and len(scores[0]) == docs.count()


# -- vectors ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, score string"


def _odd_vectors():
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist(), "s") for i in range(120)]     # many ties
    rows += [(200, None, "s"), (220, [1.0, None, 1.0, 1.0, 1.0], "s"), (240, [float("nan")] * 5, "s"), (260, [float("inf")] + [0.0] * 4, "s"),
             (None, [1.0] * 5, "s"), (280, [0.0] * 5, "s"), (300, [1.0, 2.0], "s"), (7, [1.0] * 5, "s")]
    return rows


def test_threshold_search_equals_brute_force(spark):
    from kestrel.llm.threshold_search import exact_top_k
    rows = _odd_vectors()
    vectors = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in exact_top_k(vectors, F.col("vec_id") % 10 == 0, 10, 1024).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    live = [(i, np.floor(1024 * np.array(v))) for i, v, _ in rows if i is not None and v is not None and len(v) == 5 and None not in v and np.isfinite(v).all()]
    for q, x in live:
        if q % 10 == 0:
            best = sorted(((-int(x @ y), i) for i, y in live if i != q))[:10]
            assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == {q for q, _ in live if q % 10 == 0}
    assert exact_top_k(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_threshold_search_stops_early_and_exactly():
    rng = np.random.default_rng(9)
    x = np.floor(rng.standard_normal((3000, 3)) ** 3 * 1000).astype(np.int64)
    ids = np.arange(3000)
    q, c, s = threshold_search(ids[:5], x[:5], ids, x, 10)
    for i in range(5):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(3000) if j != i)[:10]
        assert sorted((-int(b), int(a)) for a, b in zip(c[q == i], s[q == i])) == want


def test_collision_search_recall(spark):
    from kestrel.llm.ann import nearest
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(4096)
    q, c, s = ann.collision_search(ids[:40], x[:40], ids, x, 20)
    hit = 0
    for i in range(40):
        score = x @ x[i]
        score[i] = -2
        hit += len(set(np.argsort(-score)[:20]) & set(c[q == i]))
        assert np.allclose(s[q == i], score[c[q == i]])
    assert hit >= 0.9 * 800
    got = nearest(spark.createDataFrame(_odd_vectors(), VECTORS), F.col("vec_id") % 20 == 0, 20)
    ids = {r["query_id"] for r in got.collect()}
    assert ids == {0, 20, 40, 60, 80, 100}
    assert nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_recall_on_embeddings(spark):
    rows = queries.op10_ann(spark, "/root/testdata/sf0.1").collect()
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(table.embedding.values).astype(float), table.vec_id.values
    found = defaultdict(set)
    for r in rows:
        found[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for i in np.nonzero(ids % 20 == 0)[0]:
        score = x @ x[i]
        score[i] = -np.inf
        want = set(ids[np.argsort(-score)[:20]])
        hit, total = hit + len(want & found[ids[i]]), total + len(want)
    assert hit >= 0.9 * total


# -- pipeline and registry --------------------------------------------------------------------

def test_pipeline_equals_its_stages_by_hand(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near_dup", "packing"] and P.ORACLE_SQL is None
    first = P.STAGES[0][1](spark, docs, SF001)
    assert first.columns == docs.columns
    second = P.STAGES[1][1](spark, first, SF001)
    third = P.STAGES[2][1](spark, second, SF001)
    assert second.columns == third.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in second.collect()]
    want = {i for i, (_, top) in _components(left, 5, 80).items() if top == i}
    assert {r["doc_id"] for r in third.collect()} == want
    packed = P.run(spark, SF001)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == want
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF001).count() == 0


def test_words_match_the_pattern():
    texts = ["  a b\tc\x0bd\x0ce\r\nf ", "", None, "\x1fx\x1c y z", "ÀB Cd"]
    codes, vocab, starts = words_of(pa.array(texts), "ascii")
    words = vocab.to_pylist()
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, t in enumerate(texts):
        assert [words[c] for c in codes[starts[i]: starts[i + 1]]] == WORD.findall((t or "").translate(low))

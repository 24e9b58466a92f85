"""Each operator against a plain version, a round trip or held-out rows, with nulls, empties, ties, repeats and long texts."""

import hashlib
import pathlib
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import chat_perspectives, exact_topk, main_text, media_columns, ngram_join, quality_lm, repeated_bytes, sentence_pieces, source_mix, toxicity_chain
from quern.llm.bytetext import find_words, shingle_sets
from quern.llm.common import settled
from quern.llm.components import components

from . import cases

SF = "/root/testdata/sf0.001"
PAIRS = [(i, t) for i, t, _, _ in cases.ROWS]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_ngram_join(spark):
    assert rows_of(ngram_join.ngram_components(cases.documents(spark))) == cases.ngram_components(PAIRS)


def test_ngram_join_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(ngram_join.ngram_components(docs, 5, 80)) == cases.ngram_components(plain, 5, 80)


def test_ngram_join_in_a_large_group(spark):
    """Copies with a few edits each: most pairs share prefix shingles, some link, some don't."""
    rng = np.random.Generator(np.random.PCG64(3))
    base, rows = [f"t{k}" for k in range(120)], []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 7))):
            words[k] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    assert rows_of(ngram_join.ngram_components(cases.documents(spark, rows))) == cases.ngram_components([(r[0], r[1]) for r in rows])


def test_ngram_join_moves_no_sets_for_pairs_that_parities_refuse(spark, monkeypatch):
    """Each text shares a third of its shingles with five others of its size; no two link."""
    fresh = lambda mark: " ".join(f"{mark}w{k}" for k in range(60))
    rows = [(6 * i + j, f"{fresh(f'r{i}')} {fresh(f'c{j}')}", "en", "a") for i in range(6) for j in range(6)]
    asked, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (asked.append(pairs.count()), verified(pairs, *rest))[1])
    assert rows_of(ngram_join.ngram_components(cases.documents(spark, rows))) == cases.ngram_components([r[:2] for r in rows])
    assert len(asked) == 3 and not sum(asked)


def test_ngram_join_gives_up_its_counters_shuffles(spark, monkeypatch):
    """When the documents are signed, what the counters were shuffled by is no longer on disk."""
    local = spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    files = lambda: {str(p) for p in pathlib.Path(local).parent.rglob("shuffle_*.data")}
    before, left, signed = files(), [], ngram_join.signed_documents

    def late(*args):
        for _ in range(10):  # Spark removes them on another thread
            settled(spark)
            time.sleep(0.5)
            left[:] = files() - before
            if not left:
                break
        return signed(*args)

    monkeypatch.setattr(ngram_join, "signed_documents", late)
    docs = cases.documents(spark)
    assert rows_of(ngram_join.ngram_components(docs)) == cases.ngram_components(PAIRS)
    assert not left


def test_words_that_agree_modulo_powers_of_two(spark):
    """Letters by the parity of the bits of their place, and the same with both exchanged: equal under any polynomial modulo 2**64."""
    odd = [bin(k).count("1") % 2 for k in range(1024)]
    words = ["".join("ab"[x ^ k] for x in odd) for k in range(2)]
    rows = [(k, w, "en", "a") for k, w in enumerate(words)] + [(9, words[1], "en", "a")]
    assert rows_of(ngram_join.ngram_components(cases.documents(spark, rows))) == [(0, 1, 0), (1, 1, 1), (9, 1, 1)]
    assert rows_of(repeated_bytes.removal_report(cases.documents(spark, rows[:2]))) == cases.removal([r[:2] for r in rows[:2]])


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (201, 201)], "u long, v long")
    got = dict(rows_of(components(edges)))
    assert all(got[k] == 0 for k in [*range(41), 100]) and got[200] == got[201] == 200 and len(got) == 44


def test_repeated_bytes(spark):
    assert rows_of(repeated_bytes.removal_report(cases.documents(spark))) == cases.removal(PAIRS)


@pytest.mark.parametrize("length", [40, 400])
def test_repeated_bytes_on_a_table(spark, length):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(repeated_bytes.removal_report(docs, length)) == cases.removal(plain, length)


def test_planted_passages(spark):
    """Just below and just above 400 bytes, and just below and just above 51 words."""
    rng = np.random.Generator(np.random.PCG64(11))
    fresh = lambda n: " ".join(f"q{rng.integers(0, 10**9)}" for _ in range(n))
    rows = [(0, fresh(90), "en", "a")]
    for n, passage in enumerate(["x" * 399, "y" * 400, "z" * 401, *(" ".join(f"{mark}{k}" for k in range(n)) for mark, n in (("s", 52), ("u", 53)))]):
        rows += [(10 * n + k, f"{fresh(30)} {k}{passage}{k} {fresh(20 + k)}", "en", "a") for k in (1, 2)]
    got = {r[0]: r for r in repeated_bytes.removal_report(cases.documents(spark, rows)).collect()}
    assert sorted(got.values(), key=str) == cases.removal([(r[0], r[1]) for r in rows])
    assert [got[i].n_removed for i in (0, 1, 2, 11, 12, 21, 22)] == [0, 0, 0, 400, 400, 401, 401]
    assert [got[i].n_repeated_words for i in (0, 1, 31, 32, 41, 42)] == [0, 0, 0, 0, 51, 51]


def test_empty_tables(spark):
    none = cases.documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_join.ngram_components(none).count() == 0
    assert repeated_bytes.removal_report(none).count() == 0
    assert source_mix.mix_sources(none).count() == 0
    assert media_columns.media_digests(none).count() == 0
    assert sentence_pieces.encode_documents(none).count() == 0
    assert quality_lm.judge(quality_lm.score_documents(none, labels)).count() == 0
    assert toxicity_chain.score_documents(none, toxicity_chain.train_chain(none, labels), ("quality", "toxic")).count() == 0
    assert main_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat_perspectives.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.search(vectors, vectors).count() == 0


def test_words_and_shingles():
    texts = [b"A b", b"", b" \t", b"one two three four FIVE", "é è".encode()]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    starts, ends, first = find_words(buf, offsets)
    assert np.diff(first).tolist() == [2, 0, 0, 5, 2]
    assert [len(x) for x in shingle_sets(buf, offsets, 4)] == [1, 0, 0, 2, 1]


ARTICLE = "<article><header>by me</header><h1>Title &amp; all</h1><p>First <b>bold</b>\n  text.<br>More<p>Second&nbsp;one<script>var p = '</p>';</script></p><div class='comments'>nice!</div><aside>see also</aside><ul><li>item one<li>item two</ul></article>"


def page(body, extra=""):
    return f"<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>home</a></nav>{extra}{body}<form>mail <input></form><footer>&copy; us</footer></body></html>"


def test_main_text(spark):
    want = "Title & all\nFirst bold text. More\nSecond one\nitem one\nitem two"
    wide = "<div class='post-12'><p>" + "long words here " * 30 + "</p></div>"
    rows = [(1, "http://a.example/1", page(ARTICLE)), (2, None, None), (3, "http://a.example/2", ""), (4, "http://a.example/3", page(ARTICLE, "<div id='cookie-notice'>we use cookies</div>")), (5, "x", "just < text"), (6, "http://b.example/", page(wide)), (6, "http://b.example/", page(wide))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("winner", F.lit(1))
    for most in (0, 10):
        got = main_text.extract_main_text(frame, most).collect()
        by = {r.page_id: r for r in got}
        assert len(got) == 7 and by[1].text == by[4].text == want and by[1].n_chars == len(want)
        assert by[2].text == by[3].text == "" and by[5].text == "just < text" and by[6].text == ("long words here " * 30).strip()


@pytest.mark.parametrize("html", ["<a " * 300_000, "<div>" * 100_000 + "deep", "<b>" * 50_000 + "</i>" * 50_000 + "x", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<script></script " * 60_000, '<p "' * 200_000, "<!--" * 200_000, "<p>word</p>" * 40_000])
def test_page_time_grows_with_the_page(html):
    began = time.process_time()
    main_text.cut_out(main_text.parse_page(html), "html>body", ["html>body"])
    assert time.process_time() - began < 10


def test_unfinished_markup():
    assert main_text.cut_out(main_text.parse_page("<p>one <!-- two"), None, None) == "one"
    assert main_text.cut_out(main_text.parse_page("<p>one < two <a three"), None, None) == "one < two <a three"
    assert main_text.cut_out(main_text.parse_page("<div class='a>b'><p>one</div>two<?php"), None, None) in ("one", "one\ntwo")


def test_host_consensus():
    """A page whose advert is longer than its article follows the host's other pages."""
    odd = main_text.parse_page(page("<article><p>short story</p></article><div class='box'>" + "buy now " * 50 + "</div>"))
    assert "buy now" in main_text.cut_out(odd, None, None)
    assert main_text.cut_out(odd, "html>body>article", ["html>body>article"]) == "short story"


@pytest.mark.parametrize(
    ("inner", "kept"),
    [('<h2 class="section-header">Part one</h2>', "Part one"), ('<div class="share-price"><p>Up by two</p></div>', "Up by two"), ('<p class="notice-board">On the board</p>', "On the board"), ('<div class="menu-of-the-day"><p>Soup</p></div>', "Soup"), ('<header><h1>Heading <svg><text>x</text></svg>here</h1><p>by me</p></header>', "Heading here"), ('<span class="header-note">inline</span>', "inline"), ('<div class="reader-comments">nice!</div><div class="ad-slot">buy</div><div class="sidebar">side</div>', None)],
)
def test_classes_inside_an_article(inner, kept):
    html = page(f"<article><p>The story goes on and on for a while.</p>{inner}<p>It ends here.</p></article>")
    assert main_text.cut_out(main_text.parse_page(html), None, None).split("\n") == ["The story goes on and on for a while.", *([kept] if kept else []), "It ends here."]


def test_votes_on_suspects(spark):
    """Of classes that prove nothing, a box that repeats its text or is links goes from all pages of its host, one with a text of its own stays; another host has no votes of this one."""

    def story(k, host):
        own = [f"Story {k} of {host} begins with these words.", f"Section {k}", f"It costs {k} euros today.", f"Story {k} of {host} ends."]
        boxes = "<div class='newsletter-box'>Get our letter</div>", f"<div class='related-box'><a href='/x'>Read story {k + 1} next</a></div>"
        return page(f"<article><p>{own[0]}</p>{boxes[0]}<h2 class='section-header'>{own[1]}</h2><div class='share-price'><p>{own[2]}</p></div>{boxes[1]}<p>{own[3]}</p></article>"), own, ["Get our letter", f"Read story {k + 1} next"]

    rows, want = [], {}
    for k in range(12):
        host = "one.example" if k < 11 else "two.example"
        html, own, boxes = story(k, host)
        rows.append((k, f"http://{host}/{k}", html))
        want[k] = own if k < 11 else [own[0], boxes[0], own[1], own[2], boxes[1], own[3]]
    got = main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.split("\n") for r in got} == want


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", "late"), (2, 0, "system", "alone"), (None, None, None, "lost")]
    got = {(r.conv_id, r.speaker, r.block): r for r in chat_perspectives.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "unknown", 0)}
    one = got[(1, "ann", 0)]
    assert one.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n" + "<|user name=bob|>\n<|end|>\n" * 2
    cuts, at = [], 0
    for part in one.mask.split(","):
        n, train = map(int, part.split(":"))
        cuts += [one.text[at : at + n]] * train
        at += n
    assert at == len(one.text) and cuts == ["hi<|end|>\n"] and one.n_trained == len(cuts[0])


def test_chat_perspectives_without_a_conversation_and_very_long_ones(spark):
    rows = [(None, 1, "ann", "one"), (None, 1, "ann", "one"), (None, None, "system", "s"), *((7, t, "ann" if t % 2 else None, f"said {t} " * 40) for t in range(2000))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"speaker": F.lit("clash"), "block": F.lit(5), "turns": F.lit(1), "said": F.lit(1)})
    got = chat_perspectives.rotate_perspectives(frame).collect()
    lone = [r for r in got if r.conv_id is None]
    assert len(lone) == 2 and all((r.speaker, r.block, r.n_turns, r.n_own, r.text) == ("ann", 0, 1, 1, "<|assistant|>\none<|end|>\n") for r in lone)
    long = [r for r in got if r.conv_id == 7]
    assert len(long) == 2 * 8 and sum(r.n_own for r in long) == 2000 and sum(r.n_turns for r in long) == 4000
    duck = duckdb.connect()
    duck.register("conversations", pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    theirs = duck.sql(chat_perspectives.ORACLE_SQL).fetchall()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in got)


def test_source_mix(spark):
    got = source_mix.mix_sources(cases.documents(spark)).collect()
    assert len(got) == len(cases.ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = rows_of(source_mix.mix_sources(cases.documents(spark)))
    assert again == sorted((tuple(r) for r in got), key=str)
    sizes, weights = {}, {"a": 3.0, "b": 1.0, "c": 2.0, None: 3.0}
    for _, text, _, source in cases.ROWS:
        sizes[source] = sizes.get(source, 0) + len(cases.WORD.findall(text or ""))
    left, total, targets = dict(sizes), 1.5 * sum(sizes.values()), {}
    while left:
        level = (total - sum(targets.values())) / sum(weights[s] for s in left)
        over = [s for s in left if weights[s] * level > 2 * sizes[s]]
        targets |= {s: 2.0 * sizes[s] for s in over} or {s: weights[s] * level for s in left}
        left = {s: n for s, n in left.items() if s not in targets}
    assert all(r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 for r in got)


def test_budgets_are_met():
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(50):
        sizes = np.unique(rng.integers(1, 400, 12))
        counts = rng.integers(1, 6, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        best = {0}
        for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
            best = {x + k * size for x in best for k in range(count + 1) if x + k * size <= budget}
        for exact in (300, 1 << 16):
            take = source_mix.fit_budget(sizes, counts, budget, exact)
            assert (take <= counts).all() and (take >= 0).all() and (take * sizes).sum() <= budget
        assert int((take * sizes).sum()) == max(best)


def test_shards_and_slices_say_the_same(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.5, 60) if k < 10**6), "en", "a") for i in range(300)]
    docs, labels = cases.documents(spark, rows), spark.createDataFrame([(i, 1) for i in range(0, 300, 2)], "doc_id long, quality int")
    scores = [{r.doc_id: r.total_bits for r in quality_lm.score_documents(docs, labels, shards, slices).collect()} for shards, slices in ((2, 1), (256, 1), (4, 3))]
    assert all(len(x) == 300 and x == pytest.approx(scores[0], abs=0.05) for x in scores)


def test_counts_beyond_32_bits_and_values_beyond_their_range():
    counts = np.array([1, 2**33 + 5, 2**40])
    assert quality_lm.expanded_counts(quality_lm.squeezed_counts(counts)).tolist() == counts.tolist()
    assert quality_lm.expanded_counts(quality_lm.squeezed_counts(counts[:1])).tolist() == [1]
    assert quality_lm.decoded_bits(quality_lm.coded(np.array([-60.0, 0.0, 90.5])), 3).tolist() == [-60.0, 0.0, 90.5]
    with pytest.raises(ValueError, match="fit"):
        quality_lm.coded(np.array([9000.0]))


def test_one_rule_for_every_budget():
    """The share of each length changes little from one budget to the next, also where the window reaches its largest."""
    sizes, counts = np.arange(1, 400), np.full(399, 60)
    total, exact, last = int((sizes * counts).sum()), source_mix.EXACT_BUDGET, None
    for budget in range(exact - 40, exact + 40):
        take = source_mix.fit_budget(sizes, counts, budget)
        assert int((take * sizes).sum()) == budget and np.abs(take / counts - budget / total).max() < 0.12
        assert last is None or np.abs(take - last).sum() < 60
        last = take


def test_contradictory_labels_and_texts_of_one_id(spark):
    """The order of rows says nothing about the model."""
    rng = np.random.Generator(np.random.PCG64(8))
    docs = [(k % 200, f"{'vile nasty' if k % 3 else 'kind good'} word{rng.integers(0, 50)} text{k % 7}") for k in range(400)]
    labels = [(k % 200, int(k % 3 > 0), int(k % 5 > 1)) for k in range(400)]
    models = []
    for order in (range(400), reversed(range(400)), rng.permutation(400).tolist()):
        order = list(order)
        chain = toxicity_chain.train_chain(spark.createDataFrame([docs[k] for k in order], "doc_id long, text string").repartition(3), spark.createDataFrame([labels[k] for k in order], "doc_id long, a int, b int"))
        models.append((np.concatenate([m.weights for m in chain.models]), [m.bias for m in chain.models], chain.thresholds))
    assert all((m[0] == models[0][0]).all() and m[1:] == models[0][1:] for m in models)


def test_exact_topk(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (900, 16)).astype(np.float32))]
    rows += [(900, rows[0][1]), (901, None), (902, [1.0, None]), (903, [float("nan")] * 16), (904, [0.5]), (950, rows[1][1]), (950, rows[1][1]), (None, rows[2][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(exact_topk.search(frame, frame.where("vec_id % 50 = 0")))
    whole = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in {i: x for i, x in whole if i is not None and i % 50 == 0}.items():
        best = sorted((-int(x @ v), i if i is not None else 1 << 62, i) for i, v in whole if i != q and len(v) == len(x))[:5]
        want += [(q, k + 1, i, -s) for k, (s, _, i) in enumerate(best)]
    assert got == sorted(want, key=str)


def test_exact_topk_broadcasts_no_product(spark, monkeypatch):
    """Queries are broadcast in parts of a fixed size, never once for each block of the table."""
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 4)
    vectors = np.random.Generator(np.random.PCG64(6)).normal(0, 0.2, (3000, 64)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    whole = np.floor(256 * vectors.astype(np.float64)).astype(int)
    scores = whole[::50] @ whole.T
    want = [(q, k + 1, i, s) for q, own in zip(range(0, 3000, 50), scores, strict=True) for k, (s, i) in enumerate(sorted(((s, i) for i, s in enumerate(own.tolist()) if i != q), key=lambda x: (-x[0], x[1]))[:5])]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        assert sorted(map(tuple, exact_topk.search(frame, frame.where("vec_id % 50 = 0")).collect())) == want
        monkeypatch.setattr(exact_topk.search, "__defaults__", (exact_topk.BEST, 4000))
        assert sorted(map(tuple, exact_topk.search(frame, frame.where("vec_id % 50 = 0")).collect())) == want
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    # a large block, whose rows are pruned by bounds
    index = exact_topk.Index(np.arange(3000), whole)
    for floor in (np.full(60, exact_topk.NO_SCORE), np.array([x[3] for x in want[4::5]])):
        ids, found = index.best(np.arange(0, 3000, 50), whole[::50], 5, floor)
        assert [(i, s) for i, s in zip(ids.ravel().tolist(), found.ravel().tolist(), strict=True)] == [x[2:] for x in want]


def test_sentence_pieces(spark):
    got = {r.doc_id: r for r in sentence_pieces.encode_documents(cases.documents(spark)).collect()}
    reference = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    for i, text, _, _ in cases.ROWS:
        assert list(got[i].ids) == reference.encode(text or "") and got[i].parity and got[i].restored
    back = {r.doc_id: r.text for r in sentence_pieces.decode_documents(sentence_pieces.encode_documents(cases.documents(spark))).collect()}
    assert all(back[i] == (t or "") for i, t, _, _ in cases.ROWS)


def test_parsed_model():
    with open(sentence_pieces.MODEL, "rb") as f:
        model = sentence_pieces.parse_model(f.read())
    reference = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    assert [p for p, _, _ in model.pieces] == [reference.id_to_piece(k) for k in range(reference.get_piece_size())]
    assert model.kind == sentence_pieces.BPE and model.byte_fallback


def test_media_columns(spark):
    for r in media_columns.media_digests(cases.documents(spark)).collect():
        text = next((t or "") for i, t, _, _ in cases.ROWS if i == r.doc_id).encode()
        payload = text.ljust(max(192, -(-len(text) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_media_and_digests_agree(spark):
    """What the operator stores, read by a plain demultiplexer, against the digests."""
    digests = {r.doc_id: r for r in media_columns.media_digests(cases.documents(spark)).collect()}
    for r in media_columns.media_columns(cases.documents(spark)).collect():
        body = b""
        for k in range(0, len(r.media), 188):
            packet = r.media[k : k + 188]
            if (packet[1] & 0x1F) << 8 | packet[2] == 0x0100:
                body += (b"" if not packet[1] & 0x40 else b"\0START\0") + packet[5 + packet[4] if packet[3] & 0x20 else 4 :]
        payload = b"".join(x[9 + x[8] :] for x in body.split(b"\0START\0")[1:])
        d = digests[r.doc_id]
        assert payload == r.payload and d.payload_sha256 == hashlib.sha256(payload).hexdigest() and d.media_sha256 == hashlib.sha256(r.media).hexdigest()


def test_damaged_streams_are_refused():
    payload = bytes(range(256)) * 1200
    media = media_columns.mux(payload)
    read = media_columns.demux(media)
    assert read.payload == payload and read.timestamps == [k * 3600 for k in range(25)] and len(read.random_access) == 4
    for broken in (media[: 188 * 10] + media[188 * 11 :], b"\0" + media[1:], media[:-5], b""):
        with pytest.raises(ValueError):
            media_columns.demux(broken)


def test_quality_lm(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (None, "of the and", None, None, 1), (10**6, None, "en", "s", 0)], docs.schema)
    judged = quality_lm.judge(quality_lm.score_documents(docs.unionAll(odd), labels)).collect()
    assert len(judged) == 1003 and sum(r.bits is None for r in judged) == 2
    known = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([r.keep for r in judged if known.get(r.doc_id) == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def halves(ids):
    return dict(zip(ids, quality_lm.half_of(pa.array(ids, pa.int64())).tolist(), strict=True))


@pytest.mark.parametrize("hot", [quality_lm.HOT, 50])
def test_quality_lm_is_kneser_ney(spark, monkeypatch, hot):
    """With few hot keys nearly all is asked of the shards."""
    monkeypatch.setattr(quality_lm, "HOT", hot)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()} & {i for i, _ in rows}
    want = cases.kneser_ney(rows, trusted, halves([i for i, _ in rows]), quality_lm.discounts_of, quality_lm.UNKNOWN_BITS)
    got = {r.doc_id: r.total_bits for r in quality_lm.score_documents(docs, labels).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) <= 1e-4 * (1 + want[i]) for i in want)


def test_quality_lm_counts_every_word(spark):
    """80,000 words, each in both halves."""
    half, rows = halves(list(range(1000))), []
    for h in (0, 1):
        ids = [i for i, x in half.items() if x == h][:80]
        rows += [(i, " ".join(f"w{k}x{n}" for n in range(1000)), "en", "a") for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    scored = quality_lm.score_documents(cases.documents(spark, rows), labels).collect()
    assert len(scored) == 160 and max(r.total_bits / r.n_tokens for r in scored) < 5


def test_quality_lm_trusts_every_good_label(spark):
    """4.2 million labels."""
    labels = spark.range(4_200_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    scored = quality_lm.score_documents(cases.documents(spark, [(i, "of the and", "en", "a") for i in range(300)]), labels).collect()
    assert len(scored) == 300 and all(r.trusted for r in scored)


def test_kneser_ney_sums_to_one():
    rng = np.random.Generator(np.random.PCG64(1))
    counts = np.zeros((quality_lm.HALVES, 4, 4), int)
    counts[0] = rng.integers(0, 5, (4, 4))
    d = quality_lm.discounts_of(np.array([(counts == k).sum() for k in (1, 2, 3, 4)]))
    total = counts[0].sum(1)
    backoff = np.array([d[np.minimum(row, 3)][row > 0].sum() for row in counts[0]]) / total
    assert np.allclose([(np.maximum(row - d[np.minimum(row, 3)], 0) / t).sum() + b for row, t, b in zip(counts[0], total, backoff, strict=True)], 1)
    keys = quality_lm.scramble(np.arange(50_000) % quality_lm.TABLE, np.arange(50_000) * 7 % quality_lm.WORDS)
    assert (quality_lm.unscramble(keys)[0] == np.arange(50_000) % quality_lm.TABLE).all()
    assert (quality_lm.unpack(quality_lm.pack(keys & 0xFFFFFF)) == keys & 0xFFFFFF).all()


def plain_chain(rows, labels, folds, at):
    """Probabilities of the chain by dense matrices and one example after the other."""
    size = 1 << toxicity_chain.FEATURE_BITS
    names = sorted({f for r in rows for f in r.tolist()} | {f for r in at for f in r.tolist()})
    place = {f: k for k, f in enumerate(names)}
    assert len(names) < size

    def dense(found):
        x = np.zeros((len(found), len(names)))
        for i, r in enumerate(found):
            x[i, [place[f] for f in r.tolist()]] = 1
        return x

    def fit(x, more, y):
        n1, n0 = y.sum(), (1 - y).sum()
        p1, p0, p = ((x * y[:, None]).sum(0) + 0.5) / (n1 + 1), ((x * (1 - y)[:, None]).sum(0) + 0.5) / (n0 + 1), (x.sum(0) + 1) / (len(y) + 2)
        z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        scale = np.where(np.abs(z) >= toxicity_chain.LEAST_Z, np.log(p1 / p0), 0)
        both = np.hstack([x * scale, more, np.ones((len(y), 1))])
        w, g, small = np.append(np.zeros(both.shape[1] - 1), np.log(n1 / n0)), np.full(both.shape[1], 1e-8), np.append(np.full(both.shape[1] - 1, 1e-6), 0)
        for _ in range(toxicity_chain.STEPS):
            d = both.T @ ((1 / (1 + np.exp(-np.clip(both @ w, -30, 30))) - y) / len(y)) + small * w
            g += d * d
            w = w - 0.3 * d / np.sqrt(g)
        return lambda x, more: 1 / (1 + np.exp(-np.clip(np.hstack([x * scale, more, np.ones((len(x), 1))]) @ w, -30, 30)))

    x, unseen_x, earlier, out = dense(rows), dense(at), np.zeros((len(rows), 0)), np.zeros((len(at), 0))
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        held = np.zeros(len(rows))
        for k in set(folds.tolist()):
            held[folds == k] = fit(x[folds != k], earlier[folds != k], y[folds != k])(x[folds == k], earlier[folds == k])
        out = np.column_stack([out, fit(x, earlier, y)(unseen_x, out)])
        earlier = np.column_stack([earlier, held])
    return out


def test_chain_against_dense_matrices():
    rng = np.random.Generator(np.random.PCG64(8))
    words = [f"w{k}" for k in range(80)]
    texts, labels = [], []
    for _ in range(300):
        first, second = rng.random() < 0.3, rng.random() < 0.4
        texts.append(" ".join(rng.choice(words, 12).tolist() + ["vile"] * first + ["lowly"] * second + ["mixed"] * (first and rng.random() < 0.8)))
        labels.append((int(second), int(first and (second or rng.random() < 0.7))))
    rows, y, folds = [toxicity_chain.features(t) for t in texts], np.array(labels, np.int8), rng.integers(0, toxicity_chain.FOLDS, 300)
    chain = toxicity_chain.Chain(rows[:200], y[:200], folds[:200])
    assert np.allclose(chain.chances(rows[200:]), plain_chain(rows[:200], y[:200], folds[:200], rows[200:]), atol=1e-4)
    assert chain.models[1].extra[0] != 0


def test_toxicity_of_repeated_and_very_long_texts(spark):
    rows = [(i, "calm words " * 5 + ("vilest slur" if i % 4 == 0 else "and more"), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(300)], "doc_id long, low_quality int, toxic int")
    more = [rows[399], rows[399], (500, cases.LONG + " vilest slur", "en", "a"), (501, cases.LONG, "en", "a"), (501, cases.LONG, "en", "a")]
    docs = cases.documents(spark, [*rows, *more])
    got = toxicity_chain.score_documents(docs, toxicity_chain.train_chain(docs, labels)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.p_toxic, r.is_toxic))
    assert len(got) == 405 and all(len(x) == 1 for x in by.values()) and {i for i, x in by.items() if next(iter(x))[1]} >= set(range(300, 400, 4))
    assert next(iter(by[500]))[0] > next(iter(by[501]))[0]


def test_toxicity_chain(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    vocabulary, rows, marks = [f"plain{k}" for k in range(300)], [], []
    for i in range(600):
        words, toxic = rng.choice(vocabulary, 40).tolist(), i % 5 == 0
        rows.append((i, " ".join(words + (["vilest", "slur"] if toxic else [])), "en", "a"))
        marks += [(i, 0, int(toxic))] if i < 400 else []
    labels = spark.createDataFrame([*marks, (None, 1, 1), (7, None, 0)], "doc_id long, low_quality int, toxic int")
    docs = cases.documents(spark, [*rows, (601, None, "en", "a"), (602, "", None, None)])
    got = {r.doc_id: r for r in toxicity_chain.score_documents(docs, toxicity_chain.train_chain(docs, labels)).collect()}
    assert [i for i in range(400, 600) if got[i].is_toxic] == list(range(400, 600, 5))
    assert not got[601].is_toxic and got[602].p_toxic == 0

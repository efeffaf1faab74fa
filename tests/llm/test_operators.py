"""The text operators against SQL, brute force, round trips and held-out labels."""

import re
import zlib

import numpy as np
import pytest

from tests import oracle
from tidemill.llm import html_text, language_id, ngram_join, packing, queries, substring_dedup, warc
from tidemill.llm.exact_dedup import QuotientFilter, exact_dedup
from tidemill.llm.decontamination import PositionalIndex, decontaminate
from tidemill.llm.sharding import interleaved_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, row string, n double"
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
EDGE = [
    (1, None, "en", "a", 0, 1, "x", 1.0),
    (2, "", "en", "a", 0, None, None, None),
    (3, " \t\n", None, None, 0, 1, "x", 1.0),
    (4, "one two", "en", "b", 7, 1, "x", 1.0),
    (5, "one  two", "en", "b", 7, 1, "x", 1.0),
    (5, "one  two", "en", "b", 7, 1, "x", 1.0),
    (6, LONG, "fr", "b", 5, 1, "x", 1.0),
    (7, LONG + " tail", "fr", "b", 5, 1, "x", 1.0),
    (8, "été ß 日本語 \U0001f600 <|endoftext|>", "de", None, 5, 1, "x", 1.0),
    (None, "no id here", None, "c", 5, 1, "x", 1.0),
    (9, "12 34 %% !!", "en", "c", 5, 1, "x", 1.0),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    oracle.same(queries.queries()[name](spark, oracle.SF), oracle.connect(), queries.oracle_sql()[name])


def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    from tidemill.llm.tokens import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    check_packing(docs, packing.pack_along_curve(docs), tokenizer)


def check_packing(docs, packed, tokenizer):
    ids = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(d), len(i)) for d, i in ids)
    by_id = dict(ids)
    rows = sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    at = 0
    for r in rows:  # without gaps: every place of the stream once
        assert r.sequence_id * 4096 + r.offset == at and r.offset + r.length <= 4096
        piece = by_id[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        at += r.length


def test_packing_edges(edge, none):
    from tokenizers import Tokenizer

    from tidemill.llm.tokens import vocabulary_path

    check_packing(edge, packing.pack_along_curve(edge), Tokenizer.from_file(vocabulary_path()))
    assert packing.pack_along_curve(none).count() == 0


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    key = packing.hilbert_index(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block_bits", [0, 3])
def test_quotient_filters_merge_without_loss(block_bits):
    rng = np.random.default_rng(1)
    block = 5 if block_bits else 0
    pool = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64) >> np.uint64(block_bits)) | np.uint64(block << (64 - block_bits) if block_bits else 0)
    total: dict = {}
    filters = []
    for _ in range(4):
        prints, counts = np.unique(rng.choice(pool, 300), return_counts=True)
        for p, c in zip(prints.tolist(), counts.tolist()):
            total[p] = total.get(p, 0) + c
        filters.append(QuotientFilter.from_bytes(QuotientFilter.build(prints, counts, block_bits).to_bytes()))
    prints, counts = QuotientFilter.merge(filters, block).entries(block)
    assert dict(zip(prints.tolist(), counts.tolist())) == total


def test_exact_dedup_edges(edge, none):
    rows = exact_dedup(edge).collect()
    got = {(r.doc_id, r.keep_id, r.group_size) for r in rows}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 3), (5, 4, 3), (None, None, 1)} <= got
    assert sum(r.kept for r in rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", e[1] or "") for e in EDGE})
    assert exact_dedup(none).count() == 0


def test_shards_match_the_mixture(spark, edge, none):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    rows = interleaved_shards(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    counts: dict = {}
    for r in rows:
        counts.setdefault(r.source, [0] * 8)[r.shard] += 1
        assert r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(max(c) - min(c) <= 2 for c in counts.values())
    for frame in (docs, edge):
        slots: dict = {}
        for r in interleaved_shards(frame).collect():
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(k, [])) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
    assert interleaved_shards(none).count() == 0


def test_substring_dedup_over_many_chunks(spark, edge, none, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 5_000)
    oracle.same(queries.op8_substring_dedup(spark, oracle.SF), oracle.connect(), queries.OP8)
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(edge).collect()}
    assert {(1, 0, 0), (6, 60_000, 55_000), (7, 60_001, 60_000), (5, 2, 0)} <= got
    assert substring_dedup.substring_dedup(none).count() == 0


def test_ngram_join_over_many_chunks(spark, edge, none, monkeypatch):
    for name, value in (("PACK_BYTES", 20_000), ("BUCKET_KEYS", 3_000), ("BLOCK_SHINGLES", 500), ("CHUNK_BLOCKS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    oracle.same(queries.op4_ngram_join(spark, oracle.SF), oracle.connect(), queries.OP4)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(edge).collect()}
    assert {(1, 0, 1), (2, 0, 2), (4, 1, 4), (5, 1, 4), (7, 5001, 6)} <= got
    assert ngram_join.ngram_join(none).count() == 0


@pytest.mark.parametrize("block,blocks", [(100, 1), (60, 3), (1_000_000, 8)])
def test_ngram_join_counts_every_link(spark, monkeypatch, block, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "CHUNK_BLOCKS", blocks)
    near = [(i, " ".join(f"w{k}" for k in range(60)) + f" tail{i}") for i in range(8)]
    rows = [*near, (20, near[3][1]), (21, "something else that stands alone, with no link"), (22, None)]
    got = {r.doc_id: (r.component_id, r.n_links, r.kept) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 7, i == 0) for i in [*range(8), 20]} | {21: (21, 0, True), 22: (22, 0, True)}


def test_ngram_join_of_texts_that_share_an_id_or_have_none(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (None, c), (None, c + " tail")]
    got = {(r.doc_id, r.t): r.n_links for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, t string").selectExpr("*", "t as text"), keep=("t",)).collect()}
    assert got == {row: 1 for row in rows}


def test_tile_keys_meet_for_all_linked_sets():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        bands = ngram_join.Bands(percent)
        for size in [*range(1, 60), 150, 400]:
            for _ in range(8):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                drop = rng.integers(0, max(1, size // 4) + 1)
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, size // 8) + 1)).astype(np.uint64))))
                same = len(np.intersect1d(a, b))
                if len(b) and a.tobytes() != b.tobytes() and 100 * same >= percent * (len(a) + len(b) - same):
                    assert len(np.intersect1d(ngram_join.tile_keys(a, bands), ngram_join.tile_keys(b, bands)))


def test_ngram_join_sends_only_sets_that_may_link(spark, monkeypatch):
    """Texts with a line in common form one group by their keys; its sets once met in as many tasks as the group had chunks."""
    for name, value in (("BLOCK_SHINGLES", 500), ("CHUNK_BLOCKS", 1), ("SKETCH_ROWS", 16)):
        monkeypatch.setattr(ngram_join, name, value)
    sent, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda sets, percent: sent.append(sets.count()) or links(sets, percent))
    line = " ".join(f"line{k}" for k in range(16))
    rows = [(i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(150)]
    rows.append((150, rows[70][1] + " tail"))
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i, 0) for i in range(150)} | {70: (70, 1), 150: (70, 1)}
    assert sent == [2]


def test_sketches_allow_every_link():
    rng = np.random.default_rng(5)
    for percent in (30, 60, 80, 85):
        for start in (1, 3, 12, 40, 150, 700):
            bands = ngram_join.Bands(percent)
            tile = bands.of(start)
            bands.parts(tile + 1)
            least, most = bands.starts[tile], bands.starts[tile + 2] - 1
            core = rng.integers(0, 2**63, most).astype(np.uint64)
            sets = []
            for size in rng.integers(least, most + 1, 40):
                same = rng.integers(0, size + 1) if rng.random() < 0.4 else size - rng.integers(0, size // 4 + 1)
                sets.append(np.unique(np.concatenate((core[:same], rng.integers(0, 2**63, size - same).astype(np.uint64)))))
            sets = sorted([core[:least], *sets], key=len)
            size = np.array([len(x) for x in sets])
            low = np.array([bands.of(x) == tile for x in size])
            drawn = [ngram_join.sketch(x, bands.bits(bands.of(len(x)))) for x in sets]
            bits = np.stack([ngram_join.folded(d, min(map(len, drawn))) for d in drawn])
            for across in (False, True):
                side = rng.integers(0, 2, len(sets)) if across else np.zeros(len(sets), int)
                group = ngram_join.Unions(len(sets))
                for i, j in ngram_join.may_link(size, low, side, bits, across, percent):
                    assert group.root(i) != group.root(j) and not (across and side[i] == side[j])
                    group.join(i, j)
                for i in range(len(sets)):
                    for j in range(i):
                        same = len(np.intersect1d(sets[i], sets[j]))
                        if (low[i] or low[j]) and not (across and side[i] == side[j]) and 100 * same >= percent * (size[i] + size[j] - same):
                            assert group.root(i) == group.root(j)


def test_decontamination_edges(spark, edge, none):
    bench = spark.createDataFrame([(1, "Two ONE"), (2, None), (3, "ONE, two"), (4, " ".join(f"word{i}" for i in range(100, 112))), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate(edge, bench).collect()}
    assert {(1, 0, 0, 0), (4, 2, 2, 1), (5, 2, 2, 1), (6, 60_000, 144, 1), (None, 3, 0, 0)} <= got
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(edge, bench.limit(0)).filter("contaminated").count() == 0
    near = PositionalIndex(edge, bench).proximity(4).select("doc_id").distinct().collect()
    assert {4, 5, 6, 7} == {r.doc_id for r in near}


def test_proximity_matches_by_brute_force(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta eta delta")], "item_id long, text string")
    far = ["x"] * 120
    for at, word in ((100, "alpha"), (93, "beta"), (108, "beta"), (107, "gamma")):
        far[at] = word
    rng = np.random.default_rng(2)
    texts = [" ".join(far), "alpha x beta", "", *(" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta x y z".split(), 60)) for _ in range(12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for d, text in enumerate(texts):
        w = text.split()
        for item, seq in (("1", "alpha beta gamma"), ("2", "delta epsilon zeta eta delta")):
            terms = set(seq.split())
            spans = [(s, e) for s in range(len(w)) for e in range(s + 1, min(len(w), s + 10) + 1) if terms <= set(w[s:e])]
            want[d, item] = [(s, e) for s, e in spans if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans)]
    got = sorted((r.doc_id, r.start, r.end) for r in PositionalIndex(docs, bench).proximity(10).collect())
    assert got == sorted((d, s, e) for (d, _), found in want.items() for s, e in found) and (0, 100, 109) in got
    for r in decontaminate(docs, bench, span=10).collect():
        assert r.n_near == sum(len(want[r.doc_id, i]) for i in "12") and r.near_items == [i for i in "12" if want[r.doc_id, i]]


def test_warc_round_trip(spark, none):
    pages = spark.createDataFrame([(3, "u", "<p>a"), (1, None, "<p>a"), (1, None, "<p>a"), (2, "v\n", None), (4, "w", ""), (5, "x", "é" * 100_000), (None, "y", "<p>a")], "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect())
    assert got == [(0, 4, "response", None), (1, 4, "response", None), (1, 4, "revisit", 1), (2, 0, "response", None), (3, 4, "revisit", 1), (4, 0, "revisit", 2), (5, 200_000, "response", None)]
    row = archives.first()
    for entry in row["index"]:
        assert f"WARC-Record-ID: {entry.record_id}".encode() in warc.read_record(bytes(row.content), entry.offset, entry.length)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_exported_archives_are_their_contents(spark, tmp_path):
    clash = spark.createDataFrame([(i, "u", f"<p>{i}" * 50, "x", 7, "y") for i in range(20)], "page_id long, url string, html string, sha string, payload int, first string")
    archives = warc.write_archives(clash)
    for _ in range(2):  # a repeated task replaces its file by the same
        listed = {r.archive: r.bytes for r in warc.export_archives(archives, str(tmp_path / "out")).collect()}
    contents = {r.archive: bytes(r.content) for r in archives.select("archive", "content").collect()}
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == contents and listed == {k: len(v) for k, v in contents.items()}
    assert sorted(r[0] for c in contents.values() for r in warc.records(c)) == list(range(20))


def test_html_text(spark):
    pages = spark.read.parquet(f"{oracle.SF}/pages.parquet").collect()
    for row in pages:
        inner = row.html[row.html.index("<article>") + 9 : row.html.index("</article>")]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = [html_text.WHITE.sub(" ", html_text.html.unescape(re.sub("<[^>]*>", " " if "br" in b else "", b))).strip() for b in blocks]
        assert html_text.main_text(row.html) == "\n".join(w for w in want if w)
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, ok? Accept all of them.</div>
      <div class="wrapper"><div class="content"><h2>Title</h2><p>A first &amp; long paragraph, with commas, and more of it.<p>Short; one.
      <ul><li>item</ul><p>Another long paragraph, which has clauses, and ends here.</div><div class="sidebar"><ul><li><a>Link</a></ul></div>
      <div id=comments><p>I think this is great, really. Thanks, all!</div><form><p>Subscribe, now.</form></div><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "Title\nA first & long paragraph, with commas, and more of it.\nShort; one.\nitem\nAnother long paragraph, which has clauses, and ends here."
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "a < b & c", "<p")] == ["", "", "", "a < b & c", "<p"]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_text_without_article_element():
    long = "".join(f"<p>Paragraph {i} of the entry has clauses, and more clauses, and ends here.</p>" for i in range(9))
    body = "\n".join(f"Paragraph {i} of the entry has clauses, and more clauses, and ends here." for i in range(9))
    lead = "The lead tells the whole story, in short, before it is told, at length."
    post = f"<div class=post><h1>T</h1><div class=lead>{lead}</div><div class=entry>{long}</div></div>"
    menu = "<div class=sidebar><ul><li><a>Link</a></ul></div><div class=x><ul><li><a>One</a><li><a>Two</a></ul></div>"
    want = f"T\n{lead}\n{body}"
    assert html_text.main_text(f"<html><body>{post}{menu}</body></html>") == want
    assert html_text.main_text(f"<html><body><div class=top><h1>T</h1><div class=entry>{long}</div></div>{menu}</body></html>") == f"T\n{body}"
    assert html_text.main_text(f"<div class=lead>{lead}</div><div class=entry>{long}</div>") == f"{lead}\n{body}"
    assert html_text.main_text(f"<html><body><h1>T <b>U</b></h1><div class=entry>{long}</div>{menu}</body></html>") == f"T U\n{body}"
    # Classes of an ordinary container, and a form around the page.
    assert html_text.main_text(f"<html><body><div class='post hentry tag-news'>{post}</div>{menu}</body></html>") == want
    assert html_text.main_text(f"<html><body><form action=x>{post}{menu}<div class=cookies><p>We use cookies, ok?</p></div></form></body></html>") == want
    assert html_text.main_text("<html><body><div class=cookies>We use cookies, ok? Accept all.</div></body></html>") == ""


def test_tag_paths_decide_the_text(monkeypatch):
    """On a page without a name that says anything, and on one with an article, the paths are the text."""
    para = [f"Paragraph {i} of it has clauses, and more clauses, and then ends here." for i in range(6)]
    blocks = [("div.q ul li", "One"), ("div.q ul li", "Two"), ("div.w p", para[0]), ("div.w p", para[1]), ("div.w ul li", "short item"), ("div.w p", para[2]), ("div.w p", para[3]), ("div.z ul li", "ok"), ("div.z ul li", "go"), ("div.z ul li", "on")]
    page, last = "<html><body>", ""
    for path, text in blocks:
        top = path.split()[0]
        if top != last:
            page += ("</div>" if last else "") + f"<div class={top[4:]}>"
            last = top
        page += "".join(f"<{t}>" for t in path.split()[1:]) + text + "".join(f"</{t}>" for t in reversed(path.split()[1:]))
    page += "</div></body></html>"
    assert html_text.main_text(page) == "\n".join([para[0], para[1], "short item", para[2], para[3]])
    for text in (page, f"<html><body><nav><ul><li>Menu one</ul></nav><article><h1>Head</h1><p>{para[0]}<p>{para[1]}</article><footer>by me</footer></body></html>"):
        reader = html_text.Reader(text)
        every = {u.path for u in reader.units}
        lines = [" ".join("".join(u.parts).split()) for u in reader.units]
        with monkeypatch.context() as m:
            m.setattr(html_text, "title_above", lambda *_: set())
            for some in (every, *({p} for p in every)):
                m.setattr(html_text, "content_paths", lambda paths, units, some=some: some)
                assert html_text.main_text(text) == "\n".join(x for x, u in zip(lines, reader.units) if u.path in some)
        assert html_text.content_paths(reader.paths, reader.units) != every


def test_ratios_of_paths_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        kinds = [f"k{i}" for i in range(4)]
        picked = rng.choice(kinds, 12)
        texts = [" ".join(["word"] * int(rng.integers(1, 20))) + rng.choice(["", ".", ", so."]) for _ in picked]
        reader = html_text.Reader("".join(f"<div class={k}>{t}</div>" for k, t in zip(picked, texts)))
        want = {}
        length = {k: np.mean([len(t) for a, t in zip(picked, texts) if a == k]) for k in picked}
        marks = {k: np.mean([len(re.findall("[.,]", t)) for a, t in zip(picked, texts) if a == k]) for k in picked}
        smooth = lambda of: np.convolve(np.pad([of[k] for k in picked], 1, mode="edge"), [0.25, 0.5, 0.25], "valid")
        fused = smooth(length) * (1 + smooth(marks))
        for k in set(picked):
            want[k] = np.mean(fused[picked == k])
        score, limit = html_text.path_scores(reader.units, [True] * len(reader.paths.parent))
        got = {k: score[reader.units[list(picked).index(k)].path] for k in set(picked)}
        assert got == pytest.approx(want) and limit == pytest.approx(max(0.4 * fused.std(), 0.1 * fused.mean()))


def test_html_of_long_and_deep_pages_and_repeated_rows(spark):
    import time

    began = time.time()
    for page in ("<div>a b, c" * 8000, "<div>a b, c" * 100_000, "<a b='" * 100_000, "<a " * 500_000, "<span>" * 8000 + "</div>" * 8000, "<p>" + "<span>" * 8000 + "<div>" * 8000, "<!--" * 100_000):
        html_text.main_text(page)
    assert time.time() - began < 30
    long = "<article>" + "".join(f"<p>Sentence {i}, and so on.</p>" for i in range(100_000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 99_999
    rows = [(1, "u", "<p>Text, here.</p>", 5, "x")] * 2 + [(None, None, None, 1, "y"), (2, "v", "<article><p>x<math>a+b</math> y, z.</p><div class=print>Printed, too.</div></article>", 1, "z")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "Text, here.", 11), (1, "Text, here.", 11), (2, "xa+b y, z.\nPrinted, too.", 24)]


def test_shards_by_brute_force(spark):
    import struct

    import xxhash

    def spark_hash(*parts):
        h = 42
        for p in parts:
            data = p.encode() if isinstance(p, str) else struct.pack("<i", p) if isinstance(p, bool) else p
            h = xxhash.xxh64_intdigest(data, seed=h)
        return h

    seed, shards = 17, 8
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    of: dict = {}
    for r in rows:
        crc = zlib.crc32((r.text or "").encode())
        src = spark_hash(r.source is None, r.source or "", struct.pack("<i", seed))
        of.setdefault(src, []).append((spark_hash(struct.pack("<q", r.doc_id), struct.pack("<q", crc), struct.pack("<i", seed)) >> 2, r.doc_id))
    line = []
    for src, members in of.items():
        offset = ((spark_hash(struct.pack("<Q", src), struct.pack("<i", seed + 1)) >> 11) + 1) / 2.0**53
        line += [((k + 1 - offset) / len(members), src - (src >> 63 << 64), d) for k, (_, d) in enumerate(sorted(members))]
    starts = [-(-k * len(line) // shards) for k in range(shards + 1)]
    want = {d: next((k, at - starts[k]) for k in range(shards) if starts[k] <= at < starts[k + 1]) for at, (_, _, d) in enumerate(sorted(line))}
    assert {r.doc_id: (r.shard, r.slot) for r in interleaved_shards(docs).collect()} == want


def test_quality_scores_by_brute_force(spark):
    from tidemill.llm import quality

    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    labels = spark.read.parquet(f"{oracle.SF}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    assert len(model.labels) == sum(not held_out(r.doc_id) for r in labels.filter("quality in (0, 1)").collect())
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect()[:60]:
        words = (r.text or "").encode().split()
        counts = np.zeros((1, quality.WIDTH), np.int64)
        shapes = [zlib.crc32(quality.shape(w)) % quality.SHAPES for w in words]
        for i, w in enumerate(words):
            counts[0, shapes[i]] += 1
            counts[0, quality.SHAPES + quality.PAIRS + zlib.crc32(w.lower().strip(b".,;:!?")) % quality.WORDS] += 1
            if i:
                value = lambda x, s: (s, zlib.crc32(x.lower().strip(b".,;:!?")) % quality.WORDS)
                same = value(w, shapes[i]) == value(words[i - 1], shapes[i - 1])
                counts[0, quality.SHAPES + (0 if same else (shapes[i] * 31 + shapes[i - 1] * 7 + 1) % (quality.PAIRS - 1) + 1)] += 1
        v = (model.weighted(counts) @ model.basis)[0]
        near = sorted(((float(v @ x) / max(1e-9, float(np.linalg.norm(v))), -k) for k, x in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 1e-6) ** 8 for c, _ in near]
        want = sum(w * model.labels[-k] for w, (_, k) in zip(weights, near)) / sum(weights)
        assert got[r.doc_id] == pytest.approx(want if words else model.labels.mean(), abs=2e-3)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_of_held_out_documents(spark, edge, none):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, folder).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean(judged) > 0.95
    from tidemill.llm.quality import fit_quality, score_quality

    frame = spark.read.parquet(f"{folder}/labels.parquet")
    assert score_quality(edge, fit_quality(edge, frame.limit(0))).count() == len(EDGE)
    assert score_quality(none, fit_quality(none, frame)).count() == 0


def test_quality_of_texts_without_features(spark, edge):
    from tidemill.llm.quality import fit_quality, score_quality

    docs = spark.createDataFrame([(i, f"Some words, number {i}." if i % 3 else "@@ ## 1234") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 as long) as quality")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r for r in score_quality(edge, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    share = np.mean([i % 3 > 0 for i in range(60) if not held_out(i)])
    assert all(abs(got[k].score - share) < 1e-6 for k in (1, 2, 3))
    # Far from all: cosines of zero or less weigh alike, none is lost.
    assert 0 <= model.scores(np.eye(1, model.idf.size, dtype=np.int64))[0] <= 1


def test_language_of_held_out_documents(spark, edge, none):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tagger = language_id.train_tagger(docs)
    rows = language_id.predict_language(docs, tagger).collect()
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] is not None]
    assert np.mean(judged) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(edge, tagger).collect()}
    assert all(odd[k] == ("und", 0.0) for k in (1, 2, 3, 9)) and odd[6][0] in tagger.langs
    assert language_id.train_tagger(none) is None
    assert {r.lang_pred for r in language_id.predict_language(edge, None).collect()} == {"und"}


def test_language_by_brute_force(spark):
    """Each position's probability by the plain recurrence, window by window, and their mean."""
    tagger = language_id.ByteTagger(["a", "b", "c"])
    width = language_id.WINDOW
    rows = [(1, "short"), (2, "x" * width), (3, "Ein Satz mit Umlauten: äöü. " * 9), (4, "½²"), (5, None), (6, "7 + 8"), (7, "Ⅷ"), (8, "ab " * 300), (1, "short")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict_language(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()]
    want = []
    for doc_id, text in rows:
        if not any(c.isalpha() and c not in "½²Ⅷ" for c in text or ""):
            want.append((doc_id, "und", 0.0))
            continue
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), width):
            if len(raw) < width:
                window, mine = ((raw + b" ") * width)[:width], range(len(raw))
            else:
                first = min(at, len(raw) - width)
                window, mine = raw[first : first + width], range(at - first, width)
            steps = np.frombuffer(window, np.uint8)[:, None]
            both = np.concatenate((tagger.ahead.states(steps, []), tagger.back.states(steps[::-1], [])[::-1]), axis=2)
            total += tagger._softmax(both @ tagger.out + tagger.bias)[list(mine), 0].sum(axis=0)
        want.append((doc_id, "abc"[int(total.argmax())], total.max() / len(raw)))
    order = lambda x: (x[0], x[1])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(1, "same text", "en")] * 3000 + [(i, f"text {i}", "en") for i in range(2, 1500)] + [(i, f"Satz {i}", "de") for i in range(1500, 1530)] + [(1531, "y" * 20_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {r.lang: r["count"] for r in language_id.training_sample(docs).groupBy("lang").count().collect()}
    assert counts["en"] == language_id.SAMPLE_DOCS and counts["de"] == sum(not held_out(i) for i in [*range(1500, 1530), 1531])
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 100)
    assert all(sum(len(r.text) for r in language_id.training_sample(docs).filter(f"lang = '{lang}'").collect()) <= 100 for lang in ("en", "de"))
    whole = "".join(chr(97 + i % 26) for i in range(1000)).encode()
    assert set(language_id.crops(whole).ravel()[np.arange(-48, 0)]) and b"".join(x.tobytes() for x in language_id.crops(whole))[:960] == whole[:960] and language_id.crops(whole)[-1].tobytes() == whole[-48:]


def test_gradients_of_the_recurrent_network():
    tagger = language_id.ByteTagger(["a", "b", "c"], hidden=3)
    for d in (tagger.ahead, tagger.back):
        d.table, d.inner = d.table.astype(float), d.inner.astype(float)
    tagger.out, tagger.bias = tagger.out.astype(float), tagger.bias.astype(float)
    rng = np.random.default_rng(0)
    steps, labels = rng.integers(0, 256, (6, 4)), rng.integers(0, 3, 4)
    _, grads = tagger.loss_gradients(steps, labels)
    for p, g in zip(tagger.parameters(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, losses = p[at], []
        for shift in (1e-4, -1e-4):
            p[at] = old + shift
            losses.append(tagger.loss_gradients(steps, labels)[0])
        p[at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - g[at]) < 1e-5
    fast = tagger.ahead.fast_states(steps)
    assert np.allclose(fast.transpose(0, 2, 1), tagger.ahead.states(steps, []), atol=1e-4)


def brute_similar(texts, width=5, percent=80):
    """doc_id -> smallest doc_id it reaches by links, by all pairs."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = root[a], root[b]
                for d in root:
                    if root[d] in (x, y):
                        root[d] = min(x, y)
    return root


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    folder = oracle.SF
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for number, (_, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, frames[-1], folder).write.parquet(f"{tmp_path}/{number}")
        frames.append(spark.read.parquet(f"{tmp_path}/{number}"))
        assert frames[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames]
    assert set(texts[1]) == {r.doc_id for r in queries.op5_quality(spark, folder).filter("predicted = 1").collect()}
    first: dict = {}
    for d in sorted(texts[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[1][d]), d)
    assert set(texts[2]) == set(first.values())
    assert set(texts[3]) == {d for d, r in brute_similar(texts[2]).items() if d == r}
    windows = set()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(t.encode().lower().decode())
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = low(r.text or "")
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = {d for d, t in texts[3].items() if not any(tuple(w[i : i + k]) in windows for w in [low(t)] for k in sizes for i in range(len(w) - k + 1))}
    assert set(texts[4]) == clean
    packed = p.STAGES[-1][1](spark, frames[-1], folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == clean


def test_pipeline_of_rows_without_id_or_with_a_shared_one(spark, tmp_path):
    import corpus_pipeline as p

    near = " ".join(f"w{k}" for k in range(60))
    leak = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = {name: lambda rows, f=f: sorted(((r.doc_id, r.text) for r in f(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()), key=str) for name, f in p.STAGES}
    same = lambda *rows: sorted(rows, key=str)
    exact = stage["exact dedup"]
    assert exact([(None, "a b"), (5, "a b"), (6, "a  b"), (5, "c"), (5, "c"), (5, "d"), (None, "d")]) == same((None, "a b"), (5, "c"), (None, "d"))
    assert stage["n-gram Jaccard join"]([(None, near), (1, near + " x"), (1, "else"), (2, near + " y"), (3, None), (3, None)]) == same((None, near), (1, "else"), (3, None), (3, None))
    assert stage["benchmark decontamination"]([(None, leak), (None, "clean"), (1, leak + " x"), (1, "clean")]) == same((None, "clean"), (1, "clean"))
    good, bad = "Some plain words, and more of them.", "@@ ## 1234 %% 99"
    rows = [(i, (good if i % 2 else bad) + f" {i}") for i in range(60)]
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    left = stage["quality classifier"]([*rows, (None, bad), (None, good), (100, bad), (100, good)])
    assert [r for r in left if r[0] in (None, 100)] == same((None, good), (100, good))

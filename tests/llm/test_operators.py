"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from privlink.llm import bpe, common, decontaminate, exact, graph, html, lines, minhash, queries, token_files, toxicity, urls, warc

SCHEMA = "doc_id bigint, text string, id string, n int, line string"  # the last three clash with names used inside


def _texts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [None, "", " \t\n", "one", "two words", "one", make(4), make(5), make(9), make(10), "x" * 5000, make(30_000)]
    for _ in range(12):
        base = make(rnd.randint(20, 200)).split()
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            other = list(base)
            for _ in range(rnd.randint(0, 3)):
                other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            sep = rnd.choice([" ", "  ", "\n", " \n "])
            out.append(sep.join(other) if rnd.random() < 0.5 else " ".join(other[:10]) + "\n" + " ".join(other[10:]).upper())
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    return [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, "y")]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words10(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def test_decontamination(spark, docs, empty, rows):
    longest = max((r[1] for r in rows if r[1]), key=len).split()
    items = [(1, " ".join(longest[100:130])), (2, " ".join(longest[100:130]).upper()), (3, "two, words"), (4, None), (5, "..."), (10, rows[14][1]), (11, "a b c d e f g h i j k"), (12, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    windows = {}
    for item, t in items:
        w = words10(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    for i, t, *_ in rows:
        w, hit, found = words10(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found)), i
        assert sum(s["last"] - s["first"] + 1 for s in r.spans or []) == len(hit)
    assert decontaminate.contamination(docs, bench).count() == len(rows)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {i for i in got if not got[i].n_hit}
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_near_duplicates(docs, empty, rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(label.values())


def test_large_near_duplicate_group(spark, monkeypatch):
    """A bucket over many blocks: components equal those of all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for k in rnd.sample(range(120), rnd.randint(0, 5)):
            t[k] = f"v{rnd.randrange(10**6)}"
        texts.append(" ".join(t))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(150))
    for _ in range(12):
        for i in range(150):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(label))


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    label = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == label
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bpe(docs, empty, rows):
    import public_tokenizers as P
    import tiktoken

    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    enc = bpe.tokenizer(path, P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    made = bpe.encode_decode(docs, path, P.PATTERN)
    text = {i: t or "" for i, t, *_ in rows}
    for r in made.collect():
        assert r.ids == enc.encode_ordinary(text[r.doc_id]) and bytes(r.decoded) == text[r.doc_id].encode()
    for r in bpe.decode(made, path, P.PATTERN).collect():
        assert bytes(r.decoded) == text[r.doc_id].encode()
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["word  two\n\nx " * 50, "don't 12ab  \u00a0x" * 60, "abc123" * 90, " " * 400, "x" + " " * 999 + "y  z", "éß🎉 中文 " * 50])
def test_safe_boundaries(text):
    import public_tokenizers as P

    enc = bpe.tokenizer(queries.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN)
    cut = list(bpe.pieces(text, 37))
    assert "".join(cut) == text and [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_of_long_white_space():
    import public_tokenizers as P

    enc = bpe.tokenizer(queries.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in ("a" + " " * 2_000_000 + "b", "word" * 300_000):
        assert enc.decode_bytes(bpe.encode_text(enc, text)) == text.encode()
    text = "ab" + " " * 250_000 + "cd"  # the library can still do this one at once
    assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_urls(spark):
    urls_ = [
        None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7x", "x://example.com/en/8", "x://notexample.com/en/7", "x://com/en/", "x://org?/es/", "x://a.org/es/#f", "x://b.net/de/8", "x://example.net/de/85?q",
        "x://example.com:80/en/7", "x://.com/en/", "a://b://c/en/", "x://sub.net/de", "x://org/ES/", "x://é.org/es/ü",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls_)], "page_id bigint, url string, host string")
    for r in urls.judge(df, queries.URL_RULES).collect():
        u = urls_[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), v, h + p) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, "allow", None))
        assert (r.host, r.path, r.verdict, r.rule) == (host, path, want[1], want[2]), u
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0
    many = [("allow", f"h{i}.com", f"/p{i % 7}/q") for i in range(500)]
    assert urls.match(urls.build_trie(many), "x.h8.com", "/p1/qq/r") == ("allow", "h8.com/p1/q") and urls.match(urls.build_trie(many), "h8.com", "/p1/r") is None


def test_token_files(spark, docs, empty, rows, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    assert lib.encode("a<|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    extra = ["a  b", " x", "x ", "\n", "a\n b", "a\n \nb", "a \n", "  ", "<|endoftext|> x", "it's 's ' s", "12 3,4 ,5\n 6", "a\u00a0 b \u3000 c"]
    for t, got in zip(extra, token_files.encode_batch(path, extra), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    for dictionary in (False, True):
        out = f"file://{tmp_path}/t{dictionary}"
        manifest = token_files.write(docs, path, out, 2, row_group=1 << 14, page=1 << 12, dictionary=dictionary)
        got = sorted(token_files.read(manifest, with_crc=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
        text, at = {r[0]: r[1] or "" for r in rows}, 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.n_tokens
        assert [tuple(r) for r in sorted(token_files.read(manifest, with_ids=False).collect(), key=lambda r: r.start)] == [(r.doc_id, r.start, r.n_tokens) for r in got]
        assert {r.doc_id: r.ids for r in spark.read.parquet(out).collect()} == {r.doc_id: r.ids for r in got}
        assert {r.doc_id: r.ids for r in token_files.pick(spark, out, 5, 8).collect()} == {r.doc_id: r.ids for r in got if 5 <= r.doc_id <= 8}
        assert token_files.pick(spark, out, 5, 8, with_ids=False).columns == ["doc_id", "at", "n_tokens"]
        import pyarrow.parquet as pq

        one = pq.ParquetFile(manifest.orderBy("n_tokens", ascending=False).first().path.removeprefix("file://")).metadata.row_group(0).column(3)
        assert one.has_offset_index and ("DELTA_BINARY_PACKED" in one.encodings) != dictionary
    nothing = token_files.write(empty, path, f"file://{tmp_path}/e", 2)
    assert token_files.read(nothing).count() == 0


def test_exact(docs, empty, rows, monkeypatch):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = {}
    for i, t, *_ in rows:
        by.setdefault(norm(t), []).append((-len(t or ""), i))
    for salts in (64, 1):  # 1: most groups count as hot
        monkeypatch.setattr(exact, "SALTS", salts)
        got = exact.groups(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            t = norm(next(x[1] for x in rows if x[0] == r.doc_id))
            assert (r.keep_id, r.group_size, r.text_sha256) == (min(by[t])[1], len(by[t]), hashlib.sha256(t.encode()).hexdigest())
        assert sum(r.kept for r in got) == len(by) and all(r.keep_id == r.doc_id for r in got if r.kept)
    assert exact.groups(empty).count() == 0
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(v)[1] for v in by.values())


def test_toxicity(spark, docs, empty):
    trie = toxicity.build_trie(["idiot", "scum"], ["lowe"])
    for word, kind in {"idiot": "exact", "idoit": "fuzzy", "idiott": "fuzzy", "idot": "fuzzy", "xdiot": "fuzzy", "idiocy": "", "scum": "exact", "scam": "", "lowering": "stem", "low": ""}.items():
        assert toxicity.match(trie, word) == kind, word
    plain, quoted = toxicity.features(trie, "you idiot there", {}), toxicity.features(trie, 'she said the word "idiot" there', {})
    assert plain[0] > 0 and plain[3] == 0 and quoted[0] == 0 and quoted[3] > 0
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    data = []
    for i in range(600):
        w = [rnd.choice(vocabulary) for _ in range(40)]
        if i % 6 == 0:
            for k in rnd.sample(range(40), 3):
                w[k] = rnd.choice(["wretchno", "vilek", "foulest"])
        data.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), queries.training_labels(df.select("doc_id", "toxic")))
    out = {r.doc_id: r for r in toxicity.score(df.drop("toxic"), model).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert len(held) > 60 and all(out[i].predicted == y for i, _, y in held)
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0} and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic").limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body class="has-sidebar"><header><p>Site name and a long slogan of the site</p></header>
    <nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies for many good reasons, do you agree?</div><article><h1>Head &amp; line</h1><p>First  para&eacute; with <b>bold</b>
    words<br>and more of them in it.<p>Second &lt;b&gt; paragraph.<form><input><label>Your mail</label></form><section id="comments"><p>Nice article I read it all and liked it</p></section></article>
    <aside><p>Read also this other long piece of text here</p></aside><footer>&copy; me</footer></body></html>"""
    assert html.main_text(page) == "Head & line\nFirst paraé with bold words and more of them in it.\nSecond <b> paragraph."
    df = spark.createDataFrame([(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (3, "u", "<p", "c"), (4, "u", "<article><p>a<!-- open", "c")], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect())
    assert got[1:] == [(2, "", 0), (3, "", 0), (3, "", 0), (4, "a", 1)]
    assert html.extract(df.limit(0)).count() == 0


def test_html_of_sample_pages():
    """The articles of all sample pages, read by a plain parser; names of classes and ids make no difference."""
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.blocks[-1] += " " * (tag == "br")
            if tag not in html.INLINE:
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag not in html.INLINE:
                self.blocks.append("")

        def handle_data(self, data):
            self.blocks[-1] += data * self.inside

    pages = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    assert len(pages) > 200
    for page in pages:
        parser = Article()
        parser.feed(page)
        want = "\n".join(t for b in parser.blocks if (t := " ".join(b.split())))
        assert html.main_text(page) == want
        assert html.main_text(re.sub(r"\s(?:class|id|role)=\"[^\"]*\"", "", page)) == want


def test_html_asks_for_text_first():
    def asked(node):
        return set() if isinstance(node, int) else {node[0]} | asked(node[2]) | asked(node[3])

    tree = html.tree()
    assert tree[0] < html.TEXT_FEATURES and {html.FEATURES[f] for f in asked(tree)} >= {"words", "prev_links", "next_words", "main"}


@pytest.mark.parametrize("page", ["<a " * 100_000, "<div>" * 50_000 + "</b>" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<p><li>" + "<b>" * 50_000 + "<hr>" * 50_000, "<a '>" * 50_000, "<!--" * 50_000, "<script " * 50_000])
def test_html_in_linear_time(page):
    import time

    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 5


def test_warc(spark, tmp_path):
    pages = [(i, f"http://e.com/{i}?ü \r\n%41", "same" if i % 3 == 0 else f"page {i} é" * i, "z") for i in range(40)] + [(40, None, None, "z"), (41, "u", "", "z"), (41, "u", "", "z")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, size string").repartition(3)
    index = warc.write(df, f"file://{tmp_path}/w")
    got = sorted(warc.read(index).collect(), key=lambda r: r.page_id)
    first = {}
    for i, _, h, _ in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(pages)
    for r in got:
        _, url, h, _ = next(p for p in pages if p[0] == r.page_id)
        raw = (h or "").encode()
        assert r.url == url and r.payload_bytes == len(raw) and r.payload_digest == warc.digest(raw)
        if first[h or ""] == r.page_id:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == raw
        else:
            assert r.record_type == "revisit" and r.refers_to == first[h or ""]
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(ids) == len(pages)
    some = warc.fetch(index, spark.createDataFrame([(4,), (6,), (99,)], "page_id bigint")).collect()
    assert sorted((r.page_id, r.record_type) for r in some) == [(4, "response"), (6, "revisit")]
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/e")).count() == 0
    import glob

    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(p, "rb"), read_across_frames=True).read() for p in glob.glob(f"{tmp_path}/w/*.zst"))
    assert sum(1 for _ in warc.parse_records(whole)) == len(pages)


def test_warc_reads_bundles_in_parallel(spark, tmp_path, monkeypatch):
    """Bundles are read by several tasks, and one payload in nearly all rows is written by many."""
    pages = [(i, None, "hot" if i % 8 else f"p{i}") for i in range(4000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(8)
    typed = warc.record_types(df)
    sizes = [len(p) for p in typed.select("page_id").rdd.glom().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    assert {(r.page_id, r.first) for r in typed.collect()} == {(i, None if h != "hot" or i == 1 else 1) for i, _, h in pages}
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    index = warc.write(df, f"file://{tmp_path}/w")
    bundles = index.select("bundle").distinct().count()
    read = warc.read(index)
    busy = [n for n in read.select("page_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert bundles >= 8 and len(busy) > 2 and sum(busy) == 4000


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, sf).where("predicted = 1").collect()}
    assert toxic and not toxic & {r.doc_id for r in out} and 0 < len(out) < docs.count()
    import public_tokenizers as P

    enc = bpe.tokenizer(queries.vocabulary("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == enc.encode_ordinary(text[r.doc_id]) for r in out)
    norms = [re.sub(r"[\x20\x09-\x0D]", "", text[r.doc_id]) for r in out]
    assert len(set(norms)) == len(norms)
    kept = docs.join(spark.createDataFrame([(r.doc_id,) for r in out], "doc_id bigint"), "doc_id")
    assert decontaminate.contamination(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count() == 0
    assert minhash.near_duplicates(kept).where("not kept").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash", "decontamination", "byte_bpe"]


def test_near_copies_of_the_pipeline(spark, monkeypatch):
    """The stage links at 0.80, in stars and in open buckets alike."""
    import corpus_pipeline

    monkeypatch.setattr(minhash, "BLOCK", 16)
    rnd = random.Random(14)
    texts = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(120)]
        for _ in range(10):
            t = list(base)
            for k in rnd.sample(range(120), rnd.randint(0, 3)):
                t[k] = f"v{rnd.randrange(10**6)}"
            texts.append(" ".join(t))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]

    def roots(percent):
        label = list(range(len(texts)))
        for _ in range(12):
            for i in range(len(texts)):
                for j in range(i):
                    if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        label[i] = label[j] = min(label[i], label[j])
        return set(label)

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert roots(80) < roots(85)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()} == roots(80)
    assert minhash.banding(85) == (48, 8) and minhash.banding(80) == (51, 6)


def test_misspelled_stems(spark):
    """A misspelling within the letters of a learned stem still meets the whole terms that the stem covers."""
    rnd = random.Random(15)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    family, data = ["wretcho", "wretchos", "wretchoic", "wretcholy", "wretchor"], []
    for i in range(600):
        w = [rnd.choice(vocabulary) for _ in range(40)]
        if i % 6 == 0:
            for k in rnd.sample(range(40), 3):
                w[k] = rnd.choice(family)
        data.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert any("wretchoic".startswith(s) for s in model.stems)
    for word, kind in {"wretchoic": "stem", "wretchoness": "stem", "wxetchoic": "fuzzy", "rwetchos": "fuzzy", "wetcholy": "fuzzy"}.items():
        assert toxicity.match(model.trie, word) == kind, word


def test_names_of_helper_columns(spark):
    """Columns of the table that bear the operators' own names neither clash nor change."""
    import corpus_pipeline

    names = ["_sha", "_rank", "_sid", "_ssha", "_gone", "_gid", "_hid", "_hkey", "_key", "_id", "_text", "score", "predicted", "__text", "ids", "n", "component", "spans", "kept", "line", "key", "lang", "source"]
    texts = ["one two three four five six seven", "one two three four five six seven", "eight nine ten eleven twelve", None, ""]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    bench = spark.createDataFrame([(1, "eight nine ten eleven twelve")], "item_id bigint, text string")
    whole = {r.doc_id: tuple(r) for r in df.collect()}
    model = toxicity.Model([], [], [0.0] * 6 + [-30.0])
    for made, left in (
        (exact.keep_first(df), {0, 2, 3}),
        (minhash.keep_one(df), {0, 2, 3, 4}),
        (decontaminate.clean(df, bench), {0, 1, 3, 4}),
        (lines.drop_lines(df.limit(1)), {0}),
        (toxicity.keep_clean(df, model), set(whole)),
    ):
        assert made.columns == df.columns and {r.doc_id: tuple(r) for r in made.collect()} == {i: whole[i] for i in left}
    assert set(bpe.encode_decode(df, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), outputs=("n_tokens",)).columns) == {"doc_id", "n_tokens"}
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()} == {0, 2, 3}


def test_batches_are_bounded_in_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("64m", common.BATCH_BYTES), ("100000", 100_000)):
            spark.conf.set(key, given)
            common.ship(spark)
            assert int(spark.conf.get(key).rstrip("b")) == kept
    finally:
        spark.conf.set(key, before)

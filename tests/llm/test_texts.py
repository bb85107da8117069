"""HTML, chat, media and SentencePiece operators against exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from marlstone.llm import chat_format, html_extract, media_columns, sentencepiece_bpe
from marlstone.llm.queries import PIECE_MODEL


def test_html(spark):
    pages = [
        (1, None),
        (2, ""),
        (3, "plain &amp; simple"),
        (4, "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Big &lt;news&gt;</h1><p><b>One  two<br>three &eacute; and more words to read.<p>Second\nparagraph with many other words.</p></article><footer>&copy; x</footer>"),
        (5, "<body><div id='cookie-consent'>We use cookies, accept them all</div><div class='post-content'><p>The text of this post has some length to it.</p><div class='comments'><h3>Comments</h3><p>I like it a lot</p></div></div><div class='sidebar'><ul><li><a>x</a></li></ul></div></body>"),
        (6, "<!-- open comment <p>hidden"),
    ]
    d = spark.createDataFrame([(i, h, "old") for i, h in pages], "page_id long, html string, text string")
    m = html_extract.train(spark)
    got = {r.page_id: r.text for r in html_extract.extract(d, m).collect()}
    assert got[1] == got[2] == got[6] == ""
    assert got[3] == "plain & simple"
    assert got[4] == "Big <news>\n\nOne two three é and more words to read.\n\nSecond paragraph with many other words."
    assert got[5] == "The text of this post has some length to it."
    assert html_extract.extract(d.limit(0), m).count() == 0


def text_of(page):
    """All text that the parser finds, block by block."""
    said = sorted((order, "".join(pieces)) for n in html_extract.parse(page) for order, pieces in n.segments)
    return [" ".join(t.split()) for _, t in said if t.split()]


def test_html_markup():
    assert text_of("<p>Choose <select><option>A<option>B</select> the rest</p>") == ["Choose the rest"]
    assert text_of("<button><div>Click</div></button><p>Text") == ["Text"]
    assert text_of("<p>one <button>x</p><p>two") == ["one", "two"]
    assert text_of("<p>one <svg><path d='x'><text>drawn</p><p>two</p><div>three") == ["one", "two", "three"]
    assert text_of("<p>one <svg><title>t</title></svg> two") == ["one two"]
    assert text_of("<article><p>x</p><button>Click<p>rest</p></article><div>more text") == ["x", "rest", "more text"]
    assert text_of("<p>a</p><button>Click<p>b</p><button><div>c</div></button><p>d") == ["a", "b", "d"]
    for tag in ("video", "audio", "canvas", "select", "datalist", "object", "map"):
        assert text_of(f"<div>a <{tag}>in<p>b</p></div>c") == ["a", "b", "c"]
        assert text_of(f"<div>a <{tag}><p>in</p></{tag}> b</div>") == ["a", "b"]
    assert text_of("<object>x<object><p>y</p></object><p>z</p></object><p>w") == ["w"]
    assert text_of("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds") == ["where x=1 holds"]
    assert text_of("<div hidden><p>secret</p></div><p alt='a hidden gem'>shown</p><p hidden=''>no</p>yes") == ["shown", "yes"]
    node = html_extract.parse("<div data-id='sidebar' data-class=menu title='class=x' Class='Main text' id=top>x")[1]
    assert node.names == {"main", "text", "top"}
    assert [n.tag for n in html_extract.parse("<table><tr><td>a<th>b<tr><td>c<table><tr><td>d</table><ul><li>e<li>f<ul><li>g</ul></ul>")] == ["#root", "table", "tr", "td", "th", "tr", "td", "table", "tr", "td", "ul", "li", "li", "ul", "li"]


def test_html_is_linear_and_whole(spark):
    import time

    def seconds(n):
        start = time.perf_counter()
        html_extract.parse("<div>" * n + "<li>x" * n + "</p>" * n + "</section>" * n)
        return time.perf_counter() - start

    assert seconds(40_000) < 12 * seconds(10_000) + 0.1

    def silent(n):
        start = time.perf_counter()
        html_extract.parse("<select>" * n + "</button>" * n + "<button>x" * n + "</video>" * n)
        return time.perf_counter() - start

    assert silent(40_000) < 12 * silent(10_000) + 0.1
    m = html_extract.train(spark, 300)
    body = [f"Paragraph {k} of a very long article with words enough to be text." for k in range(20_000)]
    page = "<body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{x}</p>" for x in body) + "</article>"
    d = spark.createDataFrame([(1, page), (2, page)], "page_id long, html string")
    assert [r.text for r in html_extract.extract(d, m).collect()] == ["\n\n".join(body)] * 2


def test_html_pages_by_hand(spark):
    """Pages that no generator made."""
    m = html_extract.train(spark)
    blog = """<!doctype html><html><body><div id=masthead><a href=/>My log</a></div><div id="navigation"><ul><li><a href=/a>About</a><li><a href=/b>Archive</a></ul></div>
    <div class="blog-post"><h2>On bread</h2><p>Flour, water and salt are all that bread needs, and time.<p>Let the dough rest for a night &mdash; it rewards you.
    <blockquote>Good things wait.</blockquote><ul><li>500 g of flour<li>350 g of water</ul></div>
    <div id="respond"><h3>2 replies</h3><p>Nice!</p><p>Thanks a lot for this recipe</p></div><div id="colophon">Copyright 2020, all rights reserved</div></body></html>"""
    assert m.extract(blog) == "On bread\n\nFlour, water and salt are all that bread needs, and time.\n\nLet the dough rest for a night \u2014 it rewards you.\n\nGood things wait.\n\n500 g of flour\n\n350 g of water"
    news = """<body><header><h1>The Daily</h1><nav><a href=1>World</a> <a href=2>Sport</a></nav></header><main><article><h1>Rain again</h1><p>It rained for the third day, and the river rose by a metre.</p><aside class="related"><h4>Related</h4><ul><li><a href=3>Sun last week</a></ul></aside><p>Schools stay open, said the mayor.</p></article></main><aside class="sidebar"><p>Subscribe to our newsletter to get more of this.</p></aside><footer><p>Imprint</p></footer>"""
    assert m.extract(news) == "Rain again\n\nIt rained for the third day, and the river rose by a metre.\n\nSchools stay open, said the mayor."


def test_html_held_out(spark):
    m = html_extract.fit(spark.createDataFrame([(p,) for p in html_extract.labelled_pages(300, 1)], "html string"))
    right = total = 0
    for page in html_extract.labelled_pages(100, 2):
        nodes = html_extract.parse(page)
        for y, p, n in zip(html_extract.labels(nodes), m.marginals(nodes), nodes, strict=True):
            if n.segments:
                total += 1
                right += (p >= 0.5) == bool(y)
    assert right / total > 0.97


def test_marginals_by_enumeration():
    """Sum-product equals summing over all labellings of a small tree."""
    import itertools

    counts = {("node", 0, 0): 9, ("node", 0, 1): 7, ("tag:p", 0, 1): 5, ("tag:p", 0, 0): 2, ("edge:*", 0, 0): 6, ("edge:*", 1, 1): 5, ("edge:*", 0, 1): 2, ("edge:p", 0, 1): 2, ("edge:p", 1, 1): 4, ("edge:p", 1, 0): 1}
    m = html_extract.Model(counts)
    nodes = html_extract.parse("<div><p>a b c</p><section><p>d</p><p>e f</p></section></div>")
    own = [np.exp(sum(m.own.get(f, 0.0) for f in fs)) for fs in html_extract.features(nodes)]
    mass = np.zeros(len(nodes))
    total = 0.0
    for ys in itertools.product((0, 1), repeat=len(nodes)):
        w = html_extract.ROOT if ys[0] else 1 - html_extract.ROOT
        for k, n in enumerate(nodes):
            w *= own[k] if ys[k] else 1.0
            if k:
                w *= m.pair.get(n.tag, m.pair["*"])[ys[n.parent]][ys[k]]
        total += w
        mass += w * np.array(ys)
    assert np.allclose(mass / total, m.marginals(nodes))


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b[ROLE]x[/ROLE]<image:0> ", None, "", "\\", " [/ANS]", "[", "é😀\n"]
    roles = ["user", "assistant", "system", "to[ol]", None]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty)) for c in [1, 2, None] for t in range(12)] + [(1, 3, "user", "tie"), (1, 3, "user", "tie")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv: r for r in chat_format.digest(chat_format.format_turns(d)).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.loss_chars) == (len(mine), len(loss))
        assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digest(chat_format.format_turns(d.limit(0))).count() == 0


def test_chat_parts(spark):
    part = chat_format.PART
    d = spark.createDataFrame([(1, 0, "user")], "conv_id long, turn long, role string").withColumn("text", F.lit(None).cast("string"))
    make = lambda **k: F.struct(*[(F.lit(k.get(n)).cast(t)).alias(n) for n, t in (x.split(":") for x in part[7:-1].split(","))])
    d = d.withColumn("parts", F.array(make(type="text", text="see <this>"), make(type="image", ref="a.png", width=28, height=15), make(type="audio", ref="b.wav", seconds=1.5), make(type="document", ref="c.pdf", pages=2)))
    row = chat_format.format_turns(d, parts="parts").first()
    assert row.formatted == "<s>[INST] see \\<this><image:0><audio:1><document:2> [/INST]</s>"
    assert [(a.place, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1200)]
    assert row.expanded_tokens == 1242


def test_chat_parts_are_read_back(spark):
    rng = random.Random(5)
    pieces = ["<image:0>", "see \\<this>", " [/ANS]", "</s>[INST] ok [/INST]", "é"]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.choice(["text", "image", "audio", "document"])
            parts.append(("text", rng.choice(pieces), None, None, None, None, None) if kind == "text" else (kind, None, f"ref{rng.randint(0, 9)}", 20, 20, 1.0, 3))
        rows.append((i, 0, rng.choice(["user", "assistant", "to[ol]\\", "system"]), None, parts))
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{chat_format.PART}>")
    made = chat_format.format_turns(d, parts="parts")
    for r in made.collect():
        role, parts = chat_format.read_turn(r.formatted, [a.asDict() for a in r.attachments])
        want = []
        for kind, text, ref, *_ in rows[r.conv][4]:
            if kind == "text" and want and want[-1][0] == "text":
                want[-1] = ("text", want[-1][1] + text)  # neighbouring texts are one
            else:
                want.append((kind, text if kind == "text" else ref))
        assert role == rows[r.conv][2]
        assert [(p["type"], p.get("text", p.get("ref"))) for p in parts] == want
    # an image and the text that looks like its placeholder differ; the loss is read from its span alone
    two = spark.createDataFrame([(1, 0, "assistant", None, [("image", None, "a", 9, 9, None, None)]), (2, 0, "assistant", None, [("text", "<image:0>", None, None, None, None, None)])], d.schema)
    both = chat_format.format_turns(two, parts="parts")
    a, b = (r.turns_sha256 for r in chat_format.digest(both).orderBy("conv").collect())
    assert a != b
    shifted = both.where("conv = 2").withColumn("loss_start", F.col("loss_start") + 2)
    assert chat_format.digest(shifted).first().loss_chars == 8
    long = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", "x[" * 500) for k in range(3000)], "conv_id long, turn long, role string, text string")
    row = chat_format.digest(chat_format.format_turns(long)).first()
    assert (row.n_turns, row.loss_chars) == (3000, 1_500_000)


def test_media_formats():
    rng = np.random.default_rng(1)
    grey, rgb = rng.integers(0, 256, (5, 7), dtype="u1"), rng.integers(0, 256, (4, 3, 3), dtype="u1")
    text = lambda a: " ".join(map(str, a.ravel())).encode()
    bits = (grey > 127).astype("u1")
    packed = np.packbits(bits, axis=1).tobytes()
    same = lambda data, want: np.array_equal(media_columns.decode(data), want)
    assert same(b"P5\n# c\n7 5\n255\n" + grey.tobytes(), grey)
    assert same(b"P2 7 5 255\n" + text(grey), grey)
    assert same(b"P6 3 4 255\n" + rgb.tobytes(), rgb)
    assert same(b"P3 3 4 255\n" + text(rgb), rgb)
    assert same(b"P4 7 5\n" + packed, (1 - bits) * 255)
    assert same(b"P1 7 5\n" + text(bits), (1 - bits) * 255)
    line = b"".join(r[:, ::-1].tobytes() + b"\0" * (-9 % 4) for r in rgb[::-1])
    head = b"BM" + (54 + len(line)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"\1\0\x18\0" + b"\0" * 24
    assert same(head + line, rgb)
    for broken in (b"", b"P5", b"P5 9 9 255\n1", b"BMxx", b"GIF89a", head[:40]):
        assert media_columns.decode(broken) is None


def bmp(columns, rows, bits, body, packing=0, palette=b"", masks=b""):
    """A bitmap file made by the format's definition."""
    start = 54 + len(masks) + len(palette)
    little = lambda x, n=4: x.to_bytes(n, "little", signed=x < 0)
    head = b"BM" + little(start + len(body)) + bytes(4) + little(start) + little(40) + little(columns) + little(rows)
    return head + b"\1\0" + little(bits, 2) + little(packing) + little(len(body)) + bytes(8) + little(len(palette) // 4) + bytes(4) + masks + palette + body


def test_bitmaps():
    rng = np.random.default_rng(2)
    same = lambda data, want: np.array_equal(media_columns.decode(data), want)
    colours = rng.integers(0, 256, (16, 3), dtype="u1")
    palette = b"".join(bytes([b, g, r, 0]) for r, g, b in colours.tolist())
    for bits in (1, 4, 8):
        grid = rng.integers(0, min(16, 1 << bits), (5, 7), dtype="u1")
        lines = []
        for row in grid[::-1].tolist():
            digits = "".join(format(x, f"0{bits}b") for x in row)
            digits += "0" * (-len(digits) % 32)
            lines.append(bytes(int(digits[k : k + 8], 2) for k in range(0, len(digits), 8)))
        used = palette[: 4 * min(16, 1 << bits)]
        assert same(bmp(7, 5, bits, b"".join(lines), palette=used), colours[grid])
        assert same(bmp(7, -5, bits, b"".join(lines[::-1]), palette=used), colours[grid])
    # run lengths: a run, a literal, an end of line, a jump, an end
    eight = bytes([3, 5, 0, 3, 1, 2, 3, 0, 0, 0, 2, 7, 0, 2, 2, 1, 1, 9, 0, 1])
    want = np.array([[0, 0, 0, 0, 9, 0], [7, 7, 0, 0, 0, 0], [5, 5, 5, 1, 2, 3]])
    assert same(bmp(6, 3, 8, eight, 1, palette), colours[want])
    four = bytes([5, 0x12, 0, 0, 0, 3, 0x34, 0x50, 0, 0, 0, 1])
    assert same(bmp(5, 2, 4, four, 2, palette), colours[np.array([[3, 4, 5, 0, 0], [1, 2, 1, 2, 1]])])
    pixels = rng.integers(0, 1 << 15, (3, 4), dtype="u2")
    part = lambda m, top: np.round(m * 255.0 / top).astype("u1")
    want = np.stack([part(pixels >> 10 & 31, 31), part(pixels >> 5 & 31, 31), part(pixels & 31, 31)], -1)
    assert same(bmp(4, -3, 16, pixels.astype("<u2").tobytes()), want)
    masks = b"".join(x.to_bytes(4, "little") for x in (0xF800, 0x7E0, 0x1F))
    want = np.stack([part(pixels >> 11 & 31, 31), part(pixels >> 5 & 63, 63), part(pixels & 31, 31)], -1)
    assert same(bmp(4, -3, 16, pixels.astype("<u2").tobytes(), 3, masks=masks), want)
    rgb = rng.integers(0, 256, (2, 3, 3), dtype="u1")
    masks = b"".join(x.to_bytes(4, "little") for x in (0xFF, 0xFF00, 0xFF0000))
    assert same(bmp(3, -2, 32, np.concatenate([rgb, np.zeros((2, 3, 1), "u1")], 2).tobytes(), 3, masks=masks), rgb)
    for broken in (bmp(4, 3, 16, b""), bmp(4, 3, 8, bytes(12)), bmp(4, 3, 2, bytes(99)), b"P2 2 1 0 0 0", b"P5 2 1 70000\n" + bytes(9)):
        assert media_columns.decode(broken) is None


def test_area_resize():
    a = np.arange(24, dtype="u1").reshape(4, 6)
    assert np.allclose(media_columns.area_resize(a, 2, 3), a.reshape(2, 2, 3, 2).mean((1, 3)))
    b = np.random.default_rng(0).integers(0, 256, (5, 7), dtype="u1")
    fine = np.kron(b, np.ones((3 * 1, 2)))
    assert np.allclose(media_columns.area_resize(b, 3, 2), fine.reshape(3, 5, 2, 7).mean((1, 3)))
    assert media_columns.area_resize(b, 8, 9).shape == (8, 9)


def test_media_texts(spark):
    texts = [None, "", "é", "x" * 64, "y" * 65, "x" * 64]
    d = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, tile binary")
    rows = {r.doc_id: r for r in media_columns.store_texts(d).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.tile), hashlib.sha256(bytes(r.tile)).hexdigest())
        assert media_columns.from_npy(bytes(r.tile)).tobytes() == payload
    assert rows[3].feature == rows[5].feature
    m = spark.createDataFrame([(1, None), (2, bytearray(b"P5 2 1 255\n\x00\xff")), (3, bytearray(b"junk"))], "i int, m binary")
    got = {r.i: r.dhash for r in media_columns.tiles(m, "m", 4, 4).collect()}
    assert got[1] is None and got[3] is None and len(got[2]) == 16


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_sentencepiece_like_the_library(library):
    e = sentencepiece_bpe.Encoder(sentencepiece_bpe.Vocabulary.load(PIECE_MODEL))
    rng = random.Random(4)
    signs = ["a", "b", "e", "the", " ", "  ", "    ", "▁", "é", "ß", "中", "\n", "\t", "😀", "́", "<s>", "</s>", "<0x0A>", "1", "0", "ing", "tion", "Ω", "\x00", "한", "‍"]
    for k in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) if k else " " * 100
        ids = np.frombuffer(e.encode(text), "<u4").tolist()
        assert ids == [library.bos_id(), *library.encode(text), library.eos_id()], text
        assert e.decode(np.array(ids, "i8")) == library.decode(ids)
        some = [rng.choice([rng.randint(3, 258), rng.randint(259, 31999), 0, 1, 2]) for _ in range(rng.randint(0, 8))]
        assert e.decode(np.array(some, "i8")) == library.decode(some)


def test_sentencepiece_columns(spark, library):
    texts = [None, "", "Hello world", "Hello world", "long " * 3000, "w" * 5000]
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in sentencepiece_bpe.round_trip(d, PIECE_MODEL).collect()}
    for i, t in enumerate(texts):
        ids = [1, *library.encode(t or ""), 2]
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = sentencepiece_bpe.decode_ids(sentencepiece_bpe.encode_texts(d, PIECE_MODEL), PIECE_MODEL)
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert sentencepiece_bpe.round_trip(d.limit(0), PIECE_MODEL).count() == 0

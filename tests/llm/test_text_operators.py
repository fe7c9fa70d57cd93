"""Tokens, language, HTML, chat and media against brute force."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import bpe, chat, flac, html_text, langid, queries

RAW = bpe.read_ranks(queries.RANKS)
VOCABULARY = bpe.Vocabulary(RAW)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, feature string"


def documents(spark, texts):
    """Also with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", None, None, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


HARD = [None, "", "a", "'s's ''s 'll 'LL  \n\n x", "é漢字² 12 ½ <|endoftext|>", "ab " * 40_000, "x" * 30_000, "\0 \t", "'re've'm", "same", "same"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab '’slvetr\n \t 　12²é漢.,<|>'d", max_size=40), max_size=5))
def test_bpe_equals_the_regex_tokenizer(texts):
    ids, counts = VOCABULARY.encode(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == REFERENCE.encode_ordinary(t)
        assert VOCABULARY.decode(ids[a:b]) == t.encode()


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert VOCABULARY.decode(VOCABULARY.encode([text])[0]) == text.encode()


def test_bpe_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, sf_dir).collect()}
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        ids, t, g = REFERENCE.encode_ordinary(r["text"] or ""), (r["text"] or "").encode(), got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest())


def test_bpe_hard_texts_and_offsets(spark):
    docs = documents(spark, HARD)
    got = {r["doc_id"]: r for r in bpe.encode(docs, queries.RANKS).collect()}
    for i, t in enumerate(HARD):
        want = REFERENCE.encode_ordinary(t or "")
        sizes = [len(REFERENCE.decode_single_token_bytes(x)) for x in want]
        assert got[i]["ids"] == want and got[i]["offsets"] == [sum(sizes[:k]) for k in range(len(sizes))][: len(want)] if len(want) < 500 else True
        assert len(got[i]["ids"]) == len(want)
    assert bpe.digests(docs.where("false"), queries.RANKS).count() == 0


def test_ngram_counts():
    from collections import Counter

    texts = ["Ab a'ü x1. AB", "", "zz\0zz", "ÉÉ é"]
    r, g, n = langid.ngrams(texts)
    for i, t in enumerate(texts):
        chars = "".join(c if c.isalpha() else "\0" for c in f"\0{t.lower()}\0")
        want = Counter(x for k in range(1, len(chars) - 1) if chars[k] != "\0" for x in (chars[k], "2" + chars[k - 1 : k + 1], "3" + chars[k - 1 : k + 2]))
        assert sorted(n[r == i].tolist()) == sorted(want.values())


def test_language_on_held_out_documents(spark, sf_dir):
    got = queries.op5_language_id(spark, sf_dir).toPandas()
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    both = got.merge(rows, on="doc_id")
    assert len(both) == len(rows)
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]).all()
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert both["score"].between(0, 1).all()


def test_language_edges(spark):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages(documents(spark, [None, "", "123 !!", "words here", "words there", "des mots"])).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] in ("en", "fr")
    nothing = documents(spark, ["some text"]).withColumn("lang", F.lit(None).cast("string"))
    assert [tuple(r)[2:] for r in langid.languages(nothing).collect()] == [("und", 0.0)]
    assert langid.languages(nothing.where("false")).count() == 0


def test_html_query(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op2_html_text(spark, sf_dir).collect()}
    for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


PAGE = """<html><body class="has-comments"><header><h1>Site</h1></header><div id="main-menu"><a href=x>Home</a></div><div class="cookie-notice">We use cookies here</div>
<div class="post-content"><h1>Title</h1><p>First &amp; long paragraph of the article, with   many words.<p>No.<div class="ad">Buy now</div><ul><li>One<li>Two</ul>
<form><p>Search</p></form></div><div class="comments"><p>I do not agree with this at all, it is a very long comment.</p></div><div class=sidebar>Other</div><footer>Foot</footer>"""


def test_html_parts():
    assert html_text.main_text(PAGE) == "Title\nFirst & long paragraph of the article, with many words.\nNo.\nOne\nTwo"
    assert html_text.main_text(PAGE.replace('class="post-content"', "")).startswith("Title\nFirst")
    assert "Buy" not in html_text.main_text(PAGE.replace('class="post-content"', ""))


def test_html_noise_inside_a_line_leaves_one_block():
    page = "<article><p>One <span class='ad'>buy <b>now</b></span> two <a class=share>tweet</a><br>three.<p>Four <button>ok<p>five</button> six</article>"
    assert html_text.main_text(page) == "One two three.\nFour\nfive six"


LOREM = "This sentence is one of many in the text of the article, and it has some length of its own."


def test_html_without_any_marks():
    """No article element and no telling class: the windows and the blocks decide."""
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Part {i}</a>" for i in range(9)) + "</ul></div>"
    side = "<div><p>Short words.</p><p>More of it.</p></div>"
    body = "<div><h2>A headline</h2><p>By a writer</p>" + f"<p>{LOREM} {LOREM}</p><p>No.</p><p>{LOREM}</p><ul><li>One<li>Two</ul><p>The end.</p></div>"
    want = f"A headline\nBy a writer\n{LOREM} {LOREM}\nNo.\n{LOREM}\nOne\nTwo\nThe end."
    assert html_text.main_text(f"<html><body>{menu}{side}{body}{side}{menu}</body>") == want
    # teasers in elements called article do not outweigh the text
    teasers = "".join(f"<article><h3><a href=/{i}>Read the story number {i}</a></h3></article>" for i in range(8))
    assert html_text.main_text(f"<body>{menu}{body}<div>{teasers}</div></body>") == want


def test_html_headings_sections_and_forms():
    page = f"<article><h2 id='related-work'>Related work</h2><p>{LOREM}</p><section id='discussion'><h2 id=navigation>Navigation</h2><p>{LOREM}</section><div class=ad>Buy</div><div class=share>x</div><p>Z.</p><div id=comments><p>{LOREM}</div></article>"
    assert html_text.main_text(page) == f"Related work\n{LOREM}\nNavigation\n{LOREM}\nZ."
    wrapped = f"<body><form><div class=menu>Menu menu</div><p>{LOREM} {LOREM}</p><p>Z.</p><div class=sidebar>Side {LOREM}</div></form><p>Top</p></body>"
    assert html_text.main_text(wrapped).startswith(f"{LOREM} {LOREM}\nZ.") and "Side" not in html_text.main_text(wrapped) and "Menu" not in html_text.main_text(wrapped)


def test_html_long_and_deep_pages():
    import time

    start = time.perf_counter()
    many = "<body>" + "".join(f"<div><p>{LOREM} {i}</p></b>" for i in range(50_000)) + "<footer>Foot"
    got = html_text.main_text(many)
    assert len(many) > 5_000_000 and got.count("\n") == 49_999 and "Foot" not in got
    assert time.perf_counter() - start < 60


def test_html_depth_costs_one_pass():
    """Blocks in blocks: looking up each one's story and holder doesn't climb through all of them."""

    class Counting(list):
        reads = 0

        def __getitem__(self, i):
            Counting.reads += 1
            return super().__getitem__(i)

    n = 3000
    holders = Counting([0, *range(n)])
    live = [html_text.Line(f"{LOREM} {i}", False, False, 0, i) for i in range(1, n + 1)]
    got = html_text.own_story(live, holders, {1, 2000})
    begin, end = html_text.bounds(got, [len(x.text) if i > n // 3 else 1 for i, x in enumerate(got)], holders)
    assert (got[0].holder, begin, end) == (1, n // 3 + 1, len(got)) and Counting.reads < 20 * n


def test_html_query_with_other_element_names(spark, sf_dir):
    """Without article elements the pages still give their text."""
    for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        page = re.sub(r"<(/?)article\b", r"<\1div", r["html"])
        assert html_text.main_text(page) == html_text.main_text(r["html"])


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<script>x", "<!-- only", "<nav>menu", "a < b"])
def test_html_edges(page):
    assert html_text.main_text(page) == {"<nav>menu": "", "a < b": "a < b"}.get(page, "")


def test_html_empty_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x")], "page_id bigint, url string, html string, text string")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "", 0)]
    assert html_text.extract(df.where("false")).count() == 0


def chats(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        whole, learned = out.setdefault(c, ([], []))
        whole.append(f"{role or ''}\n{text or ''}\n")
        if role == "assistant":
            learned.append(text or "")
    return {c: (len(w), hashlib.sha256("".join(w).encode()).hexdigest(), len("".join(k)), hashlib.sha256("".join(k).encode()).hexdigest()) for c, (w, k) in out.items()}


def test_chat_query(spark, sf_dir):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    extra = "\\### Assistant: </turn> ok"
    want = chats([*rows, (-7, 0, "user", extra), (-7, 1, "assistant", extra)])
    assert {r["conv_id"]: tuple(r)[1:5] for r in queries.op7_chat_format(spark, sf_dir).collect()} == want


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (2, 0, "assistant", "a\\b ### </turn>\n: \\\\"), (2, 0, "assistant", "a\\b ### </turn>\n: \\\\"), (3, 5, "as: sistant", "é" * 5000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.assembled(df, queries.RANKS), queries.RANKS).collect()} == chats(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\\#</turn>: \n", max_size=30))
def test_chat_escapes(text):
    done = chat.escape(text)
    assert chat.unescape(done) == text
    assert not re.search(r"(?<!\\)(?:\\\\)*(?:###|</turn>)", done)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1500), max_size=4))
def test_flac_round_trip(payloads):
    streams = flac.encode(payloads)
    whole, starts = flac.decode(streams) if streams else ([], [])
    assert [(w.view(np.uint8) ^ 128).tobytes() for w in whole] == payloads
    assert [len(s) for s in starts] == [-(-len(p) // flac.BLOCK) for p in payloads]


def test_flac_without_a_seek_table_and_with_damage():
    payload = b"some words, some words, and more" * 100
    stream = flac.encode([payload])[0]
    n = int.from_bytes(stream[43:46], "big")
    bare = b"fLaC\x80" + stream[5:42] + stream[46 + n :]
    assert (flac.decode([bare])[0][0].view(np.uint8) ^ 128).tobytes() == payload
    broken = bytearray(stream)
    broken[-20] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def crc_of(data, width, poly):
    c = 0
    for byte in data:
        c ^= byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (width - 1) else 0)) & ((1 << width) - 1)
    return c.to_bytes(width // 8, "big")


def hand_made_stream(frames, total):
    """A FLAC stream of subframes: pairs of bits ('0110...') and samples, as the format describes them."""
    info = (16).to_bytes(2, "big") + (65535).to_bytes(2, "big") + bytes(6) + (8000 << 44 | 7 << 36 | len(total)).to_bytes(8, "big") + hashlib.md5(total.astype(np.int8).tobytes()).digest()
    out = b"fLaC\x80" + len(info).to_bytes(3, "big") + info
    for number, (bits, n) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x70, 0x02, number]) + (n - 1).to_bytes(2, "big")
        head += crc_of(head, 8, 0x07)
        body = head + int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
        out += body + crc_of(body, 16, 0x8005)
    return out


def bits_of(value, width):
    return format(value & ((1 << width) - 1), f"0{width}b") if width else ""


def residual_bits(residual, order, n, method, parts, escaped):
    """Partitioned Rice codes; partitions whose number is in `escaped` are plain numbers."""
    out, span, at = bits_of(method, 2) + bits_of(parts, 4), n >> parts, 0
    for k in range(1 << parts):
        part = residual[at : at + span - (order if k == 0 else 0)]
        at += len(part)
        wide = 4 + method
        if k in escaped:
            raw = max((int(v).bit_length() + 1 for v in part if v), default=0)
            out += "1" * wide + bits_of(raw, 5) + "".join(bits_of(int(v), raw) for v in part)
        else:
            rice = k % 5 + (12 if method and k == 1 else 0)
            out += bits_of(rice, wide)
            for v in part:
                z = int(v) << 1 if v >= 0 else (-int(v) << 1) - 1
                out += "0" * (z >> rice) + "1" + bits_of(z, rice)
    return out


@pytest.mark.parametrize("order,precision,shift", [(1, 5, 3), (2, 12, 10), (8, 9, 7), (32, 15, 12), (0, 0, 0), (3, 0, 0)])
@pytest.mark.parametrize("method,parts,escaped", [(0, 0, ()), (0, 3, (0, 2, 5)), (1, 2, (3,)), (1, 0, (0,))])
def test_flac_streams_of_other_encoders(order, precision, shift, method, parts, escaped):
    """Linear predictors of any order, fixed ones (precision 0), both Rice methods, partitions, escapes; with constant and verbatim frames."""
    rng = np.random.default_rng(order + 100 * parts)
    n = 512
    x = np.clip(np.cumsum(rng.integers(-4, 5, n)), -128, 127)
    x[n // 2 : n // 2 + 200] = 0  # a partition of zeros, which takes no bits a number
    if precision:
        c = [int(v) for v in rng.integers(-(1 << precision - 1), 1 << precision - 1, order) // order]
        head = bits_of(32 + order - 1, 6)
        numbers = bits_of(precision - 1, 4) + bits_of(shift, 5) + "".join(bits_of(v, precision) for v in c)
    else:
        c, head, numbers = [[], [1], [2, -1], [3, -3, 1]][order], bits_of(8 + order, 6), ""
    guess = [sum(v * int(x[i - 1 - j]) for j, v in enumerate(c)) >> shift for i in range(order, n)]
    coded = "0" + head + "0" + "".join(bits_of(int(v), 8) for v in x[:order]) + numbers + residual_bits(x[order:] - np.array(guess, int), order, n, method, parts, escaped)
    noise = rng.integers(-128, 128, 40)
    frames = [(coded, n), ("0" + bits_of(0, 6) + "0" + bits_of(-7, 8), 30), ("0" + bits_of(1, 6) + "0" + "".join(bits_of(int(v), 8) for v in noise), 40)]
    total = np.concatenate([x, np.full(30, -7), noise])
    whole, starts = flac.decode([hand_made_stream(frames, total)])
    assert (whole[0] == total).all() and starts[0].tolist() == [0, n, n + 30]


def test_flac_feature_sample_by_sample():
    x = np.random.default_rng(5).integers(-128, 128, 1000).astype(np.int8)
    values = [int(v) for v in x]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(values, values[1:]))
    want = f"blocks=3;mean={sum(values) / 1000:.6f};rms={(sum(v * v for v in values) / 1000) ** 0.5:.6f};peak={max(map(abs, values))};crossings={crossings}"
    assert flac.feature(x, np.array([0, 400, 800])) == want


def test_flac_of_an_empty_table(spark):
    assert flac.features(documents(spark, ["a"]).where("false")).count() == 0


def test_flac_query_and_blocks(spark):
    texts = [None, "", "ab", "x" * 64, "é" * 3000, "same", "same"]
    got = {r["doc_id"]: r for r in flac.features(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(got[5])[1:] == tuple(got[6])[1:]
    rows = flac.blocks(flac.from_flac(flac.to_flac(flac.payloads(documents(spark, texts))))).where("doc_id = 4").orderBy("offset").collect()
    assert b"".join(bytes(r["samples"]) for r in rows)[:6000] == texts[4].encode() and rows[1]["offset"] == flac.BLOCK


def test_language_of_marks_alone_and_against_brute_force(spark):
    """The out-of-place distance, n-gram by n-gram."""
    from collections import Counter

    texts = ["́̈ ́", "the cat and the hat", "le chat et la souris", "the souris", None]
    docs = documents(spark, texts)
    rows = docs.select(F.struct("doc_id", "text").alias("row"))
    profiles = langid.learned(docs.where("doc_id in (1, 2)"))
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows, profiles, "row").collect()}
    assert got[0] == got[4] == ("und", 0.0)

    def grams(t):
        chars = "".join(c if c.isalpha() else "\0" for c in f"\0{t.lower()}\0")
        code = lambda c: sum(ord(x) << 21 * i for i, x in enumerate(reversed(c))) + {1: 0, 2: 1 << 62, 3: 1 << 63}[len(c)]
        n = Counter(code(x) for k in range(1, len(chars) - 1) if chars[k] != "\0" for x in (chars[k], chars[k - 1 : k + 1], chars[k - 1 : k + 2]))
        signed = lambda g: g - (1 << 64) if g >> 63 else g
        return n, signed

    def ranking(t, key):
        n, signed = grams(t)
        return sorted(n, key=lambda g: (-n[g], signed(g) if key else g))[: langid.PROFILE]

    for i in (1, 2, 3):
        own, best = ranking(texts[i], False), []
        for lang in sorted(profiles):
            theirs = {g: k for k, g in enumerate(ranking(texts[{"en": 1, "fr": 2}[lang]], True))}
            best.append(sum(abs(theirs[g] - k) if g in theirs else langid.PROFILE for k, g in enumerate(own)))
        assert got[i] == (sorted(profiles)[int(np.argmin(best))], pytest.approx(1 - min(best) / (len(own) * langid.PROFILE)))


def test_teasers_of_other_stories_go():
    story = "<p>" + "A paragraph of the story that is long enough to count as a text of the page, with more words. " * 2 + "</p>"
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>Some short text of another story that one may like to read, number {i}.</p></article>" for i in range(5))
    for page in (f"<body><main>{story * 4}{teasers}</main></body>", f"<body><article>{story * 4}<section>{teasers}</section></article></body>"):
        assert "Teaser" not in html_text.main_text(page) and html_text.main_text(page).count("\n") == 3
    # a story inside a main element that says little of its own stays, and so do stories of equal rank
    assert html_text.main_text(f"<body><main><p>Welcome to this site of ours.</p><article>{story * 4}</article></main></body>").count("of the story") == 8
    assert html_text.main_text(f"<body><main><article>{story * 2}</article><article>{story * 2}</article></main></body>").count("of the story") == 8


def test_class_words_inside_an_article_are_whole_names():
    story = "<p>" + "A paragraph of the story that is long enough to count as a text of the page. " * 2 + "</p>"
    told = "This paragraph tells of the impact of it all, and it is of some length, too."
    for name, stays in (("social-impact", True), ("share", False), ("share-buttons", False), ("related-articles", False), ("ad", False), ("adSlot", False), ("x-ads", True)):
        assert (told in html_text.main_text(f"<body><article>{story}<p class='{name}'>{told}</p>{story}</article></body>")) == stays, name

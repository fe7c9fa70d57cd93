"""Bodies of releases: titles and headers that come first, bundles of several releases, subtitles, own summaries.

Positions in a text come from its pieces: what lies between the matches of a pattern and the matches themselves, in turn,
so that one pass of the pattern gives every start and end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import similarity, tokens
from .reports import OWN_POINT_LENGTH, clean_fragment
from .text import any_phrase, compact, has_repeated_title, korean_fragment, normalize_space, once, quality_score, repaired, semantic_key

# --- fixed values: lengths, patterns and words that decide results -----------------------------------------------------
LEAST_TITLE_KEY = 8
LEAST_REMAINDER = 10
HEADER_SHARE = 0.6
MOST_SUMMARY = 5000
MOST_TITLE = 200
LEAST_SECTION = 150
MARKER_WINDOW = 250
BUNDLE_MARKER = r"(?Umd)^\s*\d{1,2}\.\s*"
BUNDLE_WORDS = ("인천", "교육청", "교육지원청", "도서관", "학교")
BUNDLE_TITLE_ENDINGS = ("실시", "개최", "운영", "모집", "가동", "상영", "전달", "시행", "확대", "선정", "발간", "지원", "추진")
BUNDLE_TITLE_REPAIRS = (
    (r"(?U)\s+([,.:;!?])", "$1"),
    (r"(?U)([‘“\"\(\[])\s+", "$1"),
    (r"(?U)\s+([’”\"\)\]])", "$1"),
    (r"(?U)(\d)\s+(년|월|일|명|개|곳|회|차|기|학년)", "$1$2"),
    (r"(?U)\s*·\s*", "·"),
    (r"(?U)\s*,\s*", ", "),
)
SUBTITLE_LEAST = 8
SUBTITLE_MOST_SCORE = 0.8
FRAGMENT_BREAK = r"(?U)[\n\r]+|(?<=[.!?])\s+|\s*[◦□○▪▫■●▲△▶◆➀-➉①-⑳※▸▹‣·]\s*"
ATTACHMENT_LEAST, ATTACHMENT_LEAD = 120, 80
# -------------------------------------------------------------------------------------------------------------------
_SPACE_ENDS = r"(?U)\A\s+|\s+\z"


def clean_lines(text: Column) -> Column:
    """The lines that say something, each with single spaces."""
    lines = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n"), normalize_space)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE_ENDS, "")


def without_label(title: Column) -> Column:
    """A title without a label in brackets before it."""
    return trimmed(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\[[^\]]+\]", ""))


_KEY = "[0-9A-Za-z가-힣]"
_NO_KEY = "[^0-9A-Za-z가-힣]"


def _after(text: Column, n: Column, before: str, char: str, after: str = "") -> Column:
    """A text from what follows its n-th `char` on, `before` being what may lie before each; the whole if `after` does not
    come there. The group is possessive: a matcher takes it round by round, and needs no stack however great n is."""
    return F.regexp_replace(text, F.concat(F.lit(rf"(?Us)\A(?:{before}*+{char}){{"), n.cast("string"), F.lit(rf"}}+{after}")), F.lit(""))


def without_title(text: Column, title: Column) -> Column:
    """A text in clean lines that no longer begins with its title: in whatever spacing (twice at most), then in whatever
    punctuation."""

    def rid(lines: Column, plain: Column, key: Column) -> Column:
        end = r"(?:\s+|\z)"
        bare = lambda t: F.regexp_replace(t, F.lit(r"(?U)\A\s+"), F.lit(""))
        cut = lambda t: bare(F.when(F.startswith(compact(t), plain), _after(t, F.length(plain), r"\s", r"\S", end)).otherwise(t))
        same = lambda t: F.rlike(t, F.lit(rf"(?U)\A\s*{_KEY}")) & F.startswith(F.regexp_replace(t, rf"{_NO_KEY}+", ""), key)
        marked = lambda t: bare(F.when(same(t), _after(t, F.length(key), _NO_KEY, _KEY, end)).otherwise(t))
        last = lambda t: F.when(has_repeated_title(t, title), marked(t)).otherwise(t)
        return F.when(F.length(plain) < LEAST_TITLE_KEY, lines).otherwise(once(once(once(lines, cut), cut), last))

    return once(clean_lines(text), lambda t: once(compact(title), lambda plain: once(semantic_key(without_label(title)), lambda key: rid(t, plain, key))))


def _ends(pieces: Column, matches: Column) -> Column:
    """How many characters of a text come before the end of each match."""
    size = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(matches, lambda m, i: size(pieces, i + 1) + size(matches, i + 1))


def without_header(text: Column, title: Column) -> Column:
    """A document from what follows its title on: the last place where the title stands, in whatever spacing and
    punctuation, with something after it; else the first line that holds the title, or most of it, and nothing else of it.

    Places are found in the text's own key, and counted in its characters. A place with another one or two after it has
    something after it, as a key is long enough for that, so the last three tell."""
    said = lambda x: F.length(normalize_space(x)) >= LEAST_REMAINDER

    def last(t: Column, key: Column) -> Column:
        def of(own: Column, pieces: Column) -> Column:
            behind = lambda k: F.aggregate(F.slice(pieces, -(k + 1), k + 1), F.lit(k) * F.length(key), lambda a, x: a + F.length(x))
            rest = lambda k: once(clean_lines(_after(t, F.length(own) - behind(k), _NO_KEY, _KEY)), lambda x: F.when(said(x), x))
            return F.coalesce(*[F.when(F.size(pieces) > k + 1, rest(k)) for k in range(3)])

        return once(semantic_key(t), lambda own: once(F.split(own, key, -1), lambda pieces: of(own, pieces)))

    def first(t: Column, key: Column) -> Column:
        def of(lines: Column) -> Column:
            long_enough = lambda k: F.length(k) >= F.greatest(F.lit(LEAST_TITLE_KEY), F.floor(F.length(key) * F.lit(HEADER_SHARE)))
            titled = lambda x: once(semantic_key(x), lambda k: long_enough(k) & (F.contains(k, key) | F.contains(key, k)))
            # what follows a later line is part of what follows this one
            rest = lambda at: F.when(at > 0, F.array_join(F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines), F.lit(1))), "\n"))
            return once(once(F.array_position(F.transform(lines, titled), F.lit(True)), rest), lambda x: F.when(said(x), x))

        return once(F.split(t, "\n"), of)

    def rid(t: Column, key: Column) -> Column:
        return F.when(F.length(key) < LEAST_TITLE_KEY, t).otherwise(F.coalesce(last(t, key), first(t, key), t))

    return once(clean_lines(text), lambda t: once(semantic_key(without_label(title)), lambda key: rid(t, key)))


def chosen_summary(title: Column, html: Column, attachment: Column, preferred: Column) -> Column:
    """struct<summary, origin>: a page's own text or its attachment's, both without title and header. An attachment wins if
    its source is preferred and it is long enough, or if it scores so much better."""

    def better(page: Column, file: Column) -> Column:
        enough = preferred & (F.length(normalize_space(file)) >= ATTACHMENT_LEAST)
        wins = (file != "") & (enough | (quality_score(file, title) > quality_score(page, title) + ATTACHMENT_LEAD))
        return F.struct(F.substring(F.when(wins, file).otherwise(page), 1, MOST_SUMMARY).alias("summary"), F.when(wins, "attachment").otherwise("html").alias("origin"))

    return once(without_title(html, title), lambda page: once(without_title(without_header(attachment, title), title), lambda file: better(page, file)))


def subtitle(document: Column, title: Column, marker: str, suffixes: Sequence[str] = (), stop_words: Sequence[str] = ()) -> Column:
    """Of the lines that a marker stands in, the one least like the title, the first of equals; null if all are like it."""

    def least(words: Column) -> Column:
        lines = F.transform(F.filter(F.split(F.coalesce(document, F.lit("")), "\r\n|[\n\r]"), lambda x: F.contains(x, F.lit(marker))), lambda x: trimmed(F.replace(x, F.lit(marker), F.lit(""))))
        scored = F.transform(lines, lambda x, i: F.struct(similarity(words, tokens(x, suffixes, stop_words)).alias("score"), i.alias("i"), x.alias("text")))
        return F.array_min(F.filter(scored, lambda s: (F.length(s["text"]) >= SUBTITLE_LEAST) & (s["score"] < SUBTITLE_MOST_SCORE)))["text"]

    return once(tokens(title, suffixes, stop_words), least)


def own_summary(body: Column, title: Column, readable: Callable[[Column], Column] = korean_fragment) -> Column:
    """Two points from a raw body where no model gave any: its first readable fragments, shortened; else its start, or its
    title."""
    short = lambda x: F.when(F.length(x) <= OWN_POINT_LENGTH, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, OWN_POINT_LENGTH - 3)), F.lit("...")))

    def points(good: Column, name: Column) -> Column:
        first = short(F.get(good, F.lit(0)))
        second = F.get(F.filter(F.slice(good, 2, F.greatest(F.size(good), F.lit(1))), lambda x: x != first), F.lit(0))
        whole = clean_fragment(normalize_space(body))
        return F.when(F.size(good) == 0, F.array(short(F.when(whole == "", name).otherwise(whole)))).otherwise(F.array_compact(F.array(first, short(second))))

    def of(name: Column) -> Column:
        cleaned = F.transform(F.split(F.coalesce(body, F.lit("")), FRAGMENT_BREAK), clean_fragment)
        return once(F.filter(cleaned, lambda x: (x != "") & (x != name) & readable(x)), lambda good: points(good, name))

    return once(normalize_space(F.when(F.coalesce(title, F.lit("")) == "", "보도자료").otherwise(title)), of)


def tidy_title(title: Column) -> Column:
    """A title put together from lines: no spaces before marks, none between a number and its unit."""
    return F.regexp_replace(normalize_space(repaired(normalize_space(title), BUNDLE_TITLE_REPAIRS)), r"\A[ ,]+|[ ,]+\z", "")


def section_title(section: Column, fallback: Column, endings: Sequence[str] = BUNDLE_TITLE_ENDINGS) -> Column:
    """A section's title from its lines: what stands before its first line comes again; else lines, one by one, until they
    end as titles do or are long enough; else its first line."""
    bare = lambda x: trimmed(F.regexp_replace(x, r"(?U)\A\d{1,2}\.\s*", ""))

    def growing(first: Column, lines: Column) -> Column:
        chunks = F.filter(F.transform(F.slice(lines, 1, 8), bare), lambda x: x != "")
        steps = F.transform(chunks, lambda _, i: F.struct(tidy_title(F.array_join(F.slice(chunks, 1, i + 1), " ")).alias("t"), i.alias("i")))
        ends = lambda s: F.rlike(s["t"], F.lit("(?:" + "|".join(endings) + r")\z")) | ((F.length(s["t"]) >= 45) & (s["i"] >= 1))
        found = F.get(F.filter(steps, ends), F.lit(0))["t"]
        return F.coalesce(found, tidy_title(F.when(first == "", fallback).otherwise(first)))

    def of(lines: Column) -> Column:
        def named(first: Column, joined: Column) -> Column:
            own = F.regexp_replace(first, r"\A[ ,]+|[ ,]+\z", "")
            again = F.position(own, joined, F.length(own) + 1)
            return F.when((F.length(own) >= 3) & (again > F.length(own) + 1), tidy_title(F.substring(joined, F.lit(1), again - 1))).otherwise(growing(first, lines))

        joined = normalize_space(F.array_join(F.slice(lines, 1, 30), " "))
        return F.when(F.size(lines) == 0, tidy_title(fallback)).otherwise(once(bare(F.get(lines, F.lit(0))), lambda first: once(joined, lambda j: named(first, j))))

    stripped = F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), "\n"), trimmed), lambda x: x != "")
    return once(stripped, of)


def bundle_sections(text: Column, words: Sequence[str] = BUNDLE_WORDS) -> Column:
    """array<struct<index, total, section>>: the numbered releases in one text, empty if there are not two.

    A number at a line's start is a marker if the line after it names an institution (one of words); a section ends at
    the next marker. Short sections are left out, and keep their numbers."""

    def cut(t: Column, pieces: Column, matches: Column) -> Column:
        def of(ends: Column) -> Column:
            after = lambda e: F.get(F.filter(F.transform(F.split(F.substring(t, e + 1, F.lit(MARKER_WINDOW)), "\n"), trimmed), lambda x: x != ""), F.lit(0))
            named = lambda x: F.coalesce((F.length(x) >= 5) & any_phrase(x, words), F.lit(False))
            marks = F.filter(F.transform(ends, lambda e, i: F.struct((e - F.length(F.get(matches, i))).alias("begin"), e.alias("end"))), lambda m: named(after(m["end"])))

            def between(ms: Column) -> Column:
                stop = lambda i: F.coalesce(F.get(ms, i + 1)["begin"], F.length(t))
                all_ = F.transform(ms, lambda m, i: F.struct((i + 1).alias("index"), F.size(ms).alias("total"), trimmed(F.substring(t, m["end"] + 1, stop(i) - m["end"])).alias("section")))
                return F.when(F.size(ms) < 2, F.array().cast("array<struct<index:int,total:int,section:string>>")).otherwise(F.filter(all_, lambda s: F.length(s["section"]) >= LEAST_SECTION))

            return once(marks, between)

        return once(_ends(pieces, matches), of)

    return once(F.coalesce(text, F.lit("")), lambda t: once(F.split(t, BUNDLE_MARKER, -1), lambda p: once(F.regexp_extract_all(t, F.lit(BUNDLE_MARKER), F.lit(0)), lambda m: cut(t, p, m))))

"""Derived WARC records: metadata and plain-text conversion records of responses. DataFrame functions only.

A response gets two linked records. Both refer to its record id, keep its target address, payload
digest, date and other headers where it has these, and have their own ids and block digests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

CRLF = "\r\n"
#: What a response may have besides, and its derived records then have as well.
SOURCE_COLUMNS = ("warc_date", "source_headers")
_BLOCKS = "p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|td|th|table|thead|tbody|article|section|nav|header|footer|main|aside|form|blockquote|pre|title|head|body|html"
_GAP = r"[ \t\n\r\f]"
#: Of a tag, what follows its name: a quoted value after = may hold >, and what is not closed ends with the page.
_INSIDE = rf"""[^>=]*+(?:={_GAP}*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+[^>=]*+)*+"""
_END = r"(?:>|\z)"


def _tag(names: str) -> str:
    return rf"(?:{names})(?:[ \t\n\r\f/]{_INSIDE})?+{_END}"


#: Comments, scripts and styles, to the end of the page where they are not closed.
HIDDEN = rf"(?is)<(?:!--.*?(?:-->|\z)|script[ \t\n\r\f/>].*?(?:</script{_GAP}*+{_END}|\z)|style[ \t\n\r\f/>].*?(?:</style{_GAP}*+{_END}|\z))"
TAG = rf"(?s)</?[A-Za-z]{_INSIDE}{_END}|<[!?/][^>]*+{_END}"
#: (pattern, replacement) in the order in which they turn markup without hidden parts into text.
TO_TEXT = (
    (rf"(?is)</?{_tag(_BLOCKS)}", "\n"),
    (TAG, ""),
)
#: Every tag in turn; of links and of the root element what follows <, to look for attributes in.
LINKING = rf"(?s)<((?:[aA]|[hH][tT][mM][lL])[ \t\n\r\f/]{_INSIDE}){_END}|</?[A-Za-z]{_INSIDE}{_END}|<[!?/][^>]*+{_END}"
#: Pages where < and > stand around tags only: cut at both, text and tags take turns.
PLAIN = rf"""\A[^<>]*(?:<[A-Za-z!?/][^<>=]*(?:={_GAP}*+(?:"[^"<>]*"|'[^'<>]*'|(?!["']))[^<>=]*)*+>[^<>]*)*+\z"""
#: A tag without what encloses it that begins a line, and those that may link. Frequent names are told without a pattern.
BLOCK = rf"\A/?(?i:{_BLOCKS})(?:[ \t\n\r\f/]|\z)"
LINK = r"\A(?:[aA]|[hH][tT][mM][lL])[ \t\n\r\f/]"
BLOCK_NAMES, INLINE_NAMES = (
    [f"{end}{name}" for lower in names.split("|") for name in (lower, lower.upper()) for end in ("", "/")]
    for names in (_BLOCKS.replace("h[1-6]", "h1|h2|h3|h4|h5|h6"), "a|abbr|b|code|em|font|i|img|label|small|span|strong|sub|sup|u")
)
#: Bytes of a page that is cut into pieces; these take many times its size, so longer ones are worked on whole, by patterns alone.
LONG = 1 << 18
_NAME, _VALUE = r"[^ \t\n\r\f\"'>/=]++", r"""(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f"'>][^ \t\n\r\f>]*+)"""
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: References with one meaning wherever they stand, looked for before the others; in whole texts ``&amp;`` is left to the end.
PLAIN_REFERENCES = (*ENTITIES[:-1], ("&middot;", "·"), ("&copy;", "©"))
#: By name with its semicolon, names that need none, and numbers that do not stand for their own character.
#: The no-break space is a blank, however it is written.
NAMED = {k: v.replace("\xa0", " ") for k, v in html5.items() if k.endswith(";")}
UNCLOSED = {k: v.replace("\xa0", " ") for k, v in html5.items() if not k.endswith(";")}
NUMBERED = {
    str(n): unescape(f"&#{n};").replace("\xa0", " ")
    for n in (*range(0xA1), *range(0xFDD0, 0xFDF0), *(plane + end for plane in range(0, 0x110000, 0x10000) for end in (0xFFFE, 0xFFFF)))
    if n == 0xA0 or unescape(f"&#{n};") != chr(n)
}
_LAST_CHARACTER = 0x10FFFF
_BLANKS = " \t\r\f\x0B"
SPACES = ((rf"[{_BLANKS}]{{2,}}+|[\t\r\f\x0B]", " "), (r" \n[ \n]*+|\n[ \n]++", "\n"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _table(of: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in of.items())), F.lit("\x02"), F.lit("\x01"))


def _numbered(reference: Column) -> Column:
    """The character of ``#233;`` or ``#xe9;``, as browsers read it."""
    digits = F.regexp_extract(reference, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    short = F.concat(F.lit("0"), F.substring(digits, 1, 7))
    number = F.when(reference.rlike("^#[xX]"), F.conv(short, 16, 10)).otherwise(F.conv(F.regexp_replace(short, "[^0-9]", ""), 10, 10)).cast("long")
    number = F.when(F.length(digits) > 7, F.lit(_LAST_CHARACTER + 1)).otherwise(number)

    def character(n: Column) -> Column:
        none = n.between(0xD800, 0xDFFF) | (n > _LAST_CHARACTER)
        code = F.when(none, F.lit(0xFFFD)).otherwise(n)
        return F.coalesce(F.try_element_at(_table(NUMBERED), n.cast("string")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    return _let(number, character)


def _after_ampersand(piece: Column) -> Column:
    """The text that stands after an ampersand, with the reference it begins with decoded if it does."""
    number = F.regexp_extract(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    name = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]{0,31};", 0)
    unclosed = F.regexp_extract(piece, "^(?:" + "|".join(sorted(UNCLOSED, key=len, reverse=True)) + ")", 0)
    named = F.try_element_at(_table(NAMED), name)

    def rest(reference: Column) -> Column:
        return F.substring(piece, F.length(reference) + 1, F.length(piece))

    def read(reference: str, character: str) -> tuple[Column, Column]:
        return F.startswith(piece, F.lit(reference[1:])), F.concat(F.lit(character), rest(F.lit(reference[1:])))

    frequent = reduce(lambda c, e: c.when(*read(*e)), PLAIN_REFERENCES, F.when(*read(*ENTITIES[-1])))  # no look-up
    return (
        frequent.when(number != "", F.concat(_numbered(number), rest(number)))
        .when(named.isNotNull(), F.concat(named, rest(name)))
        .when(unclosed != "", F.concat(F.try_element_at(_table(UNCLOSED), unclosed), rest(unclosed)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def decoded(text: Column) -> Column:
    """Text with its character references decoded once, named and numeric ones, as HTML defines them."""

    def others(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(_after_ampersand(p))), "")

    def rare(t: Column) -> Column:
        return F.when(t.rlike("&(?!amp;)[#A-Za-z]"), others(t)).otherwise(F.replace(t, F.lit("&amp;"), F.lit("&")))

    whole = _let(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), PLAIN_REFERENCES, text), rare)
    return F.when(~F.contains(text, F.lit("&")), text).when(F.octet_length(text) > LONG, whole).otherwise(others(text))


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, "")


def turns(markup: Column) -> Column:
    """Text and tags of ``visible`` markup in turn, beginning with text; null where < or > stand elsewhere, too, and of long pages."""
    return F.when((F.octet_length(markup) <= LONG) & markup.rlike(PLAIN), F.split(F.replace(markup, F.lit(">"), F.lit("<")), "<"))


def _shown(piece: Column, i: Column) -> Column:
    """What a piece of ``turns`` shows."""

    def block(name: Column) -> Column:
        return name.isin(BLOCK_NAMES) | (~name.isin(INLINE_NAMES) & piece.rlike(BLOCK))

    return F.when(i % 2 == 0, piece).when(_let(F.substring_index(piece, " ", 1), block), "\n").otherwise("")


def _spaced(text: Column) -> Column:
    """Text with each run of spaces, or of spaces and line ends, as one space or line end; none at its ends."""

    def by_patterns(t: Column) -> Column:
        return F.btrim(reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), SPACES, t), F.lit(" \n"))

    def within(t: Column) -> Column:
        found = reduce(lambda c, x: c | F.contains(t, F.lit(x)), "\t\r\f\x0B", F.contains(t, F.lit("  ")))
        return F.when(found, F.regexp_replace(t, *SPACES[0])).otherwise(t)

    lines = F.filter(F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS))), lambda line: line != "")
    return F.when(F.octet_length(text) > LONG, by_patterns(text)).otherwise(_let(F.array_join(lines, "\n"), within))


def plain_text(markup: Column, pieces: Column | None = None) -> Column:
    """The text of ``visible`` markup: lines by block elements, references decoded, spaces collapsed.

    ``pieces`` are its ``turns``, where it has them."""
    out = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), TO_TEXT, markup)
    if pieces is not None:
        out = F.coalesce(F.array_join(F.transform(pieces, _shown), ""), out)
    return _let(_let(out, decoded), _spaced)


def record_id(*parts: Column) -> Column:
    """A name-based record id: equal parts give equal ids."""
    return F.regexp_replace(F.md5(F.concat_ws("\n", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def digest_of(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None, headers: str | None = None,
) -> DataFrame:
    """Response records of a page table. Null addresses and bodies count as empty.

    ``date`` names a column with the time of the response (text or a timestamp), ``headers`` a map of its
    other header fields; they become ``warc_date`` and ``source_headers``."""
    body, address = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (html, url))
    given = []
    if date is not None:
        kind = pages.select(F.col(f"`{date}`")).schema[0].dataType
        time = F.col(f"`{date}`")
        if isinstance(kind, TimestampType):
            time = F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        given.append(time.cast("string").alias("warc_date"))
    if headers is not None:
        given.append(F.col(f"`{headers}`").cast("map<string,string>").alias("source_headers"))
    base = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), address.alias("target_uri"), body.alias("payload"), *given)
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    digested = base.withColumn("payload_digest", digest_of(F.col("payload")))  # a column, so that bodies are digested once
    source = digested.withColumn("record_id", record_id(F.lit("response"), number, F.col("target_uri"), F.col("payload_digest")))
    return source.select("page_id", "record_id", "target_uri", "payload", "payload_digest", *_carried(source))


def _carried(records: DataFrame) -> list[str]:
    return [c for c in SOURCE_COLUMNS if c in records.columns]


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name that has one, as written, without quotes; null without."""
    pattern = rf"(?:(?i:{name}){_GAP}*+={_GAP}*+({_VALUE})|{_NAME}(?:{_GAP}*+={_GAP}*+{_VALUE})?+)"
    found = F.filter(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), lambda x: x != "")
    return F.regexp_replace(F.get(found, F.lit(0)), """^["']|["']$""", "")


def metadata_block(payload: Column, markup: Column, tags: Column) -> Column:
    """Fields of a page: title, language, links out in order, size, from its visible markup and ``linking_tags``."""
    title = F.regexp_extract(markup, rf"(?is)<{_tag('title')}(.*?)(?:</title{_GAP}*+{_END}|\z)", 1)

    def values(first: str, name: str) -> Column:
        found = F.transform(F.filter(tags, lambda tag: F.lower(F.substring(tag, 1, 1)) == first), lambda tag: attribute(tag, name))
        return F.filter(found, lambda x: x.isNotNull())

    lang = F.coalesce(F.get(values("h", "lang"), F.lit(0)), F.lit(""))
    lines = F.concat(
        F.array(F.concat(F.lit("title: "), plain_text(title)), F.concat(F.lit("language: "), _one_line(lang)), F.concat(F.lit("payload-length: "), F.octet_length(payload).cast("string"))),
        F.transform(values("a", "href"), lambda x: F.concat(F.lit("outlink: "), _one_line(x))),
    )
    return F.concat(F.array_join(lines, CRLF), F.lit(CRLF))


def linking_tags(markup: Column, pieces: Column) -> Column:
    """Links and root elements of visible markup, without what encloses a tag; not those within another tag's values.

    ``pieces`` are its ``turns``, where it has them."""

    def linking(piece: Column, i: Column) -> Column:
        return (i % 2 == 1) & reduce(lambda c, x: c | F.startswith(piece, F.lit(x)), "AhH", F.startswith(piece, F.lit("a"))) & piece.rlike(LINK)

    every = F.filter(F.regexp_extract_all(markup, F.lit(LINKING), F.lit(1)), lambda tag: tag != "")
    return F.coalesce(F.filter(pieces, linking), every)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, "[\r\n]+", " ")


def derivatives(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record of each response.

    ``source`` has ``page_id``, ``record_id``, ``target_uri``, ``payload``, ``payload_digest``. Where it has
    ``warc_date`` and ``source_headers``, both records carry them on; others are ignored. Repeated responses give repeated records with equal ids; an empty payload has an empty
    conversion and a metadata block without title, language and links. Comments, scripts, styles, tags and
    quoted values that are not closed reach to the end of the page, as in browsers, and links in comments do
    not count. Every pattern passes a page once, whatever it holds."""
    shown, pieces = F.col("_visible"), F.col("_pieces")
    source = source.withColumn("_visible", visible(F.col("payload"))).withColumn("_pieces", turns(shown)).withColumn("_tags", linking_tags(shown, pieces))
    kinds = (("metadata", "application/warc-fields", metadata_block(F.col("payload"), shown, F.col("_tags"))), ("conversion", "text/plain; charset=utf-8", plain_text(shown, pieces)))
    records = F.array(*[F.struct(F.lit(k).alias("record_type"), F.lit(t).alias("content_type"), b.alias("block")) for k, t, b in kinds])
    one = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", F.col("payload_digest").alias("source_payload_digest"), *_carried(source), F.inline(records))
    return one.select(
        "page_id", "record_type", record_id(F.col("record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri",
        "source_payload_digest", "content_type", F.octet_length("block").cast("long").alias("content_length"), digest_of(F.col("block")).alias("block_digest"), "block", *_carried(source),
    )


def serialized(records: DataFrame) -> DataFrame:
    """Column ``record``: each record as text, header lines, a blank line, the block and two line ends.

    ``warc_date`` and ``source_headers`` follow the record's own lines, the latter by name. A source header
    of a name that the record has itself gets the beginning ``WARC-Source-``. Null values have no line, and
    line ends within one are blanks."""
    header = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
        *([("WARC-Date", "warc_date")] if "warc_date" in records.columns else []),
    ]
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in header]
    if "source_headers" in records.columns:
        own = [name.lower() for name, _ in header]

        def line(entry: Column) -> Column:
            name, value = (F.regexp_replace(entry[c], "[\r\n]+", " ") for c in ("key", "value"))
            apart = F.concat(F.lit("WARC-Source-"), F.regexp_replace(name, "(?i)^WARC-", ""))
            return F.concat(F.when(F.lower(name).isin(own), apart).otherwise(name), F.lit(": "), value)

        entries = F.filter(F.map_entries("source_headers"), lambda e: e["value"].isNotNull())
        lines.append(F.transform(F.array_sort(entries), line))
    return records.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2)).alias("record"))


def write_records(records: DataFrame, path: str) -> None:
    """Text files of serialized records, one part for each task."""
    serialized(records).write.option("lineSep", "").option("compression", "gzip").text(path)

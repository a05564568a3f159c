"""WARC derivatives: response records become linked ``metadata`` and plain-text ``conversion`` records.

A response is a row (record_id, target_uri, date, http_headers, payload, payload_digest).  Each gives

* a ``metadata`` record (application/warc-fields): the source's digest and HTTP header lines, the title and
  the links of the page, in order, as written;
* a ``conversion`` record (text/plain): the text of the page.

Both name the source in WARC-Refers-To (with its URI and date), keep its payload digest, carry a digest of
their own block, and have ids derived from the source's id, so a second run gives the same records.

Text: comments, scripts and styles go; tags of blocks become line ends and other tags vanish; named (the common ones)
and numeric character references are resolved, each once; runs of blanks and empty lines are closed up.

Broken pages, of any length, take time in proportion to their length: a comment, script or tag that is never closed is text, and a link's
tag ends at ``>`` or where the next ``<a`` begins.

All of it is DataFrame work without a shuffle, so neither a hot host nor copies of a page matter.  Digests are
``sha1:`` and Base32.  A null payload or header block counts as empty; a null URI or date gives no such line in the
written record; a null record id stays null and the derivatives refer to nothing.  Repeated responses give repeated
derivatives.  An empty table gives an empty result.  Other columns of the responses are ignored.

``write_warc`` and ``read_warc`` store records as uncompressed WARC/1.1 files that Spark splits at record starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table
from .common import register

VERSION = "WARC/1.1"
EOL = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: what is dropped whole, whichever begins first
DROPPED = "(?is)<(?:!--.*?-->|" + "|".join(rf"{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript", "template")) + ")"
#: what such a part opens with
OPENING = "(?i)<(?:!--|(?:script|style|noscript|template)\\b)"
#: by opening: what stands before the places from which on it is never closed
CLOSED = {"<(?=!--)": "(?s)^(.*)-->",
          **{rf"(?i)<(?={t}\b)": rf"(?is)^(.*>)[^>]*</{t}\s*>" for t in ("script", "style", "noscript", "template")}}
#: pages with more openings are searched for closers first: each opening without one would be followed to the end of the page
MANY_OPENINGS = 32
#: stands behind the "<" of openings that are never closed; its own occurrences are marked otherwise meanwhile
MARK = "\ue000"
BLOCK_TAGS = ("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
              "html li main nav ol option p pre section table tbody td tfoot th thead title tr ul").split()
BLOCK_TAG = rf"(?i)</?({'|'.join(BLOCK_TAGS)})\b[^>]*>"
ANY_TAG = r"</?[A-Za-z!?][^>]*>"
#: named character references that are resolved (fixed values), but for &amp;
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
            "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
            "euro": "€", "pound": "£", "yen": "¥", "sect": "§", "para": "¶", "deg": "°", "times": "×", "auml": "ä", "ouml": "ö", "uuml": "ü",
            "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ"}
#: a run of blanks, unless it is one space already
BLANKS = r" [ \t\r\f\x0B]+|[\t\r\f\x0B][ \t\r\f\x0B]*"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
#: an opening title, and the title behind it
TITLE_TAG, TITLE_TEXT = r"(?i)<title\b", r"(?is)^[^>]*>(.*?)</title"
LINK = r"""(?i)<a\b[^>]*?\shref\s*=\s*"([^"]*)\""""
#: also in single quotes or without, in this order of preference within a tag; the value with its quotes
LINK_TAG = r"(?i)<a\b"
ANY_LINK = (r"""(?i)^<a\b(?:[^>]*?\shref\s*=\s*(?="[^"]*")|[^>]*?\shref\s*=\s*(?='[^']*')|[^>]*?\shref\s*=\s*(?=[^\s"'>]++[\s>]))"""
            r"""("[^"]*"|'[^']*'|[^\s"'>]++)""")


def digest(data: Column) -> Column:
    """``sha1:`` and the Base32 of the SHA-1 of a text's UTF-8 bytes."""
    sha = F.sha1(data.cast("binary"))
    parts = []
    for g in range(8):  # five hex digits are four Base32 digits
        v = F.conv(F.substring(sha, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(F.lit("sha1:"), *parts)


def record_id(kind: str, source: Column) -> Column:
    """A record id that is a function of the kind of record and its source."""
    h = F.md5(F.concat(F.lit(f"{kind}|"), source).cast("binary"))
    parts = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(source.isNotNull(), F.concat(F.lit("<urn:uuid:"), parts, F.lit(">")))


def _references(text: Column) -> Column:
    """Character references, in one pass over what stands behind each ``&``; numbers that are no character become U+FFFD."""
    names = F.create_map(*[F.lit(x) for kv in {**ENTITIES, "amp": "&"}.items() for x in kv])

    def one(p: Column) -> Column:
        ref = F.substring_index(p, ";", 1)
        dec, hexa = F.regexp_extract(ref, "^#([0-9]{1,7})$", 1), F.regexp_extract(ref, "^#[xX]([0-9A-Fa-f]{1,6})$", 1)
        n = F.when(dec != "", dec.cast("int")).otherwise(F.conv(hexa, 16, 10).cast("int"))
        number = F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")
        char = F.when(~F.contains(p, F.lit(";")), F.lit(None)).when((dec != "") | (hexa != ""), number).otherwise(F.try_element_at(names, ref))
        return F.coalesce(F.concat(char, F.substring(p, F.length(ref) + 2, F.length(p))), F.concat(F.lit("&"), p))

    def whole(parts: Column) -> Column:
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))

    return F.element_at(F.transform(F.array(F.split(text, "&")), whole), 1)  # the split is worked out once


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _marked(opening: str, closed: str):
    return lambda t: _once(F.length(F.regexp_extract(t, closed, 1)), lambda n: F.concat(
        F.substring(t, F.lit(1), n), F.regexp_replace(F.substring(t, n + 1, F.length(t)), opening, f"<{MARK}s")))


def _without_dropped(html: Column) -> Column:
    """``DROPPED`` taken out, in time that grows with the page.

    An opening that is never closed stays, and so do all later ones of its kind; they are marked before the search, so none of them is
    followed to the end of the page.
    """
    t = F.replace(html, F.lit(MARK), F.lit(MARK + "n"))
    for opening, closed in CLOSED.items():
        t = _once(t, _marked(opening, closed))
    t = F.replace(F.regexp_replace(t, DROPPED, ""), F.lit(MARK + "s"), F.lit(""))
    careful = F.replace(t, F.lit(MARK + "n"), F.lit(MARK))
    return F.when(F.regexp_count(html, F.lit(OPENING)) <= MANY_OPENINGS, F.regexp_replace(html, DROPPED, "")).otherwise(careful)


def _without_tags(html: Column) -> Column:
    """Tags end at a ``>``: behind the last one there are none."""
    def one(t: Column) -> Column:
        return _once(F.substring_index(t, ">", -1), lambda rest: F.concat(F.regexp_replace(F.regexp_replace(
            F.substring(t, F.lit(1), F.length(t) - F.length(rest)), BLOCK_TAG, "\n"), ANY_TAG, ""), rest))
    return _once(html, one)


def plain_text(html: Column) -> Column:
    """The text of a page."""
    t = _without_tags(_without_dropped(html))
    t = F.regexp_replace(_references(t), BLANKS, " ")
    return F.btrim(F.regexp_replace(t, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def metadata_block(row: dict[str, Column]) -> Column:
    """warc-fields lines on a response."""
    behind = F.element_at(F.split(row["payload"], TITLE_TAG, 2), -1)
    title = F.when(row["payload"].rlike(TITLE_TAG), F.regexp_extract(behind, TITLE_TEXT, 1)).otherwise("")
    title = F.regexp_replace(title, r"[\r\n\t ]+", " ")
    bare = lambda x: F.when(F.substring(x, 1, 1).isin('"', "'"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    tags = F.transform(F.slice(F.split(row["payload"], LINK_TAG), F.lit(2), F.length(row["payload"])), lambda x: F.regexp_extract(F.concat(F.lit("<a"), x), ANY_LINK, 1))
    links = F.transform(F.filter(tags, lambda x: x != ""), lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(bare(x), r"[\r\n]+", " ")))
    headers = F.transform(F.filter(F.split(row["http_headers"], "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("source-http: "), x))
    lines = F.concat(F.array(F.concat(F.lit("source-payload-digest: "), row["payload_digest"])), headers,
                     F.array(F.concat(F.lit("title: "), title)), links)
    return F.concat(F.array_join(lines, EOL), F.lit(EOL))


def derive(responses: DataFrame, date: str) -> DataFrame:
    """Two rows a response; ``date`` is the WARC-Date of the new records.  Columns of the responses named ``source_*`` ride along."""
    r = {c: F.col(c) for c in ("record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")}
    r["payload"], r["http_headers"] = F.coalesce(r["payload"], F.lit("")), F.coalesce(r["http_headers"], F.lit(""))
    r["payload_digest"] = F.coalesce(r["payload_digest"], digest(r["payload"]))
    carried = [c for c in responses.columns if c.startswith("source_") and c != "source_payload_digest"]
    made = F.array(*[F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), block.alias("block")) for kind, mime, block in (
        ("metadata", "application/warc-fields", metadata_block(r)), ("conversion", "text/plain; charset=utf-8", plain_text(r["payload"])))])
    flat = responses.select(*carried, r["record_id"].alias("refers_to"), r["target_uri"], r["date"].alias("refers_to_date"),
                            r["payload_digest"].alias("source_payload_digest"), F.explode(made).alias("made"))
    kind = F.col("made.warc_type")
    own = F.when(kind == "metadata", record_id("metadata", F.col("refers_to"))).otherwise(record_id("conversion", F.col("refers_to")))
    return flat.select(*carried, kind.alias("warc_type"), own.alias("record_id"), "refers_to", F.col("target_uri").alias("refers_to_target_uri"),
                       "refers_to_date", F.col("target_uri").alias("target_uri"), F.lit(date).alias("date"), "made.content_type",
                       F.octet_length("made.block").cast("long").alias("content_length"), digest(F.col("made.block")).alias("block_digest"),
                       "source_payload_digest", "made.block")


#: header lines of a written record, in order, and the columns they come from
HEADERS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to",
           "WARC-Refers-To-Target-URI": "refers_to_target_uri", "WARC-Refers-To-Date": "refers_to_date", "WARC-Source-Payload-Digest": "source_payload_digest",
           "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length"}


def serialise(records: DataFrame) -> Column:
    """A record as WARC text, without the two line ends that close it."""
    lines = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in HEADERS.items() if c in records.columns]
    return F.concat(F.concat_ws(EOL, F.lit(VERSION), *lines), F.lit(EOL + EOL), F.col("block"))


def write_warc(records: DataFrame, path: str) -> None:
    records.select(serialise(records).alias("value")).write.option("lineSep", EOL + EOL).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: the header columns, ``block``, and ``whole`` (false where fewer bytes than Content-Length were found).

    Also ``payload_digest`` (WARC-Payload-Digest) and, of responses, ``http_headers`` and ``payload``, so that ``derive`` takes them.
    """
    raw = spark.read.option("lineSep", VERSION + EOL).text(path).filter("value <> ''")
    at = F.instr("value", EOL + EOL)
    head = F.concat(F.lit(EOL), F.substring(F.col("value"), F.lit(1), at - 1), F.lit(EOL))
    rest = F.substring(F.col("value"), at + 4, F.length("value")).cast("binary")
    cols = [F.nullif(F.regexp_extract(F.col("head"), rf"\r\n(?i:{name}):[ \t]*([^\r]*)\r", 1), F.lit("")).alias(c) for name, c in {**HEADERS, "WARC-Payload-Digest": "payload_digest"}.items()]
    parsed = raw.select(head.alias("head"), rest.alias("rest")).select(*cols, "rest").withColumn("content_length", F.col("content_length").cast("long"))
    block = F.substring(F.col("rest"), F.lit(1), F.coalesce(F.col("content_length"), F.lit(0)).cast("int"))
    blank = F.instr("block", EOL + EOL)
    response, length = F.lower("warc_type") == "response", F.length("block")
    http = F.when(response, F.when(blank > 0, F.substring(F.col("block"), F.lit(1), blank + 1)).otherwise(F.col("block")))
    payload = F.when(response, F.when(blank > 0, F.substring(F.col("block"), blank + 4, length)).otherwise(F.lit("")))
    return parsed.select(*HEADERS.values(), block.cast("string").alias("block"),
                         F.coalesce(F.octet_length("rest") >= F.col("content_length"), F.lit(False)).alias("whole"), "payload_digest") \
        .select("*", http.alias("http_headers"), payload.alias("payload"))


def responses_of(pages: DataFrame, date: str) -> DataFrame:
    """Response records of stored pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(EOL))
    key = F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"))
    return pages.select(F.col("page_id").alias("source_page_id"), record_id("response", key).alias("record_id"), F.col("url").alias("target_uri"),
                        F.lit(date).alias("date"), head.alias("http_headers"), html.alias("payload"), digest(html).alias("payload_digest"))


CAPTURED, DERIVED = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"


def _sql() -> str:
    def base32(x: str) -> str:
        groups = f"list_transform(range(0, 8), lambda g: ('0x' || substr(sha1({x}), 5 * g + 1, 5))::INT)"
        return f"""'sha1:' || array_to_string(list_transform({groups}, lambda v: substr('{BASE32}', ((v >> 15) & 31) + 1, 1) ||
            substr('{BASE32}', ((v >> 10) & 31) + 1, 1) || substr('{BASE32}', ((v >> 5) & 31) + 1, 1) || substr('{BASE32}', (v & 31) + 1, 1)), '')"""

    def uuid(kind: str, x: str) -> str:
        return f"regexp_replace(md5('{kind}|' || {x}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"

    q = lambda s: s.replace("'", "''")
    names = "t5"
    for name, char in ENTITIES.items():
        names = f"replace({names}, '&{name};', '{q(char)}')"
    char = lambda n: f"CASE WHEN {n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111 THEN chr({n}) ELSE chr(65533) END"
    return rf"""
WITH src AS (SELECT page_id, url, coalesce(html, '') AS html,
    {uuid('response', "concat_ws('|', page_id::VARCHAR, url)")} AS rid FROM pages),
t1 AS (SELECT *, regexp_replace(html, '{q(DROPPED)}', '', 'g') AS t1 FROM src),
t3 AS (SELECT * EXCLUDE t1, regexp_replace(regexp_replace(t1, '{q(BLOCK_TAG)}', chr(10), 'g'), '{q(ANY_TAG)}', '', 'g') AS t3 FROM t1),
t4 AS (SELECT * EXCLUDE t3, string_split(t3, '&#') AS t4 FROM t3),
t5 AS (SELECT * EXCLUDE t4, t4[1] || coalesce(array_to_string(list_transform(t4[2:], lambda p: CASE
    WHEN regexp_matches(p, '^[0-9]{{1,7}};') THEN ({char("regexp_extract(p, '^([0-9]+);', 1)::INT")}) || regexp_replace(p, '^[0-9]+;', '')
    WHEN regexp_matches(p, '^[xX][0-9A-Fa-f]{{1,6}};') THEN ({char("('0x' || regexp_extract(p, '^[xX]([0-9A-Fa-f]+);', 1))::INT")}) || regexp_replace(p, '^[xX][0-9A-Fa-f]+;', '')
    ELSE '&#' || p END), ''), '') AS t5 FROM t4),
t6 AS (SELECT * EXCLUDE t5, regexp_replace(regexp_replace(replace({names}, '&amp;', '&'), '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g') AS t6 FROM t5),
body AS (SELECT page_id, url, rid, {base32('html')} AS payload_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    array_to_string(list_concat(['source-payload-digest: ' || {base32('html')}, 'source-http: HTTP/1.1 200 OK', 'source-http: Content-Type: text/html; charset=utf-8',
        'source-http: Content-Length: ' || strlen(html), 'title: ' || regexp_replace(regexp_extract(html, '{q(TITLE)}', 1), '[\r\n\t ]+', ' ', 'g')],
        list_transform(regexp_extract_all(html, '{q(LINK)}', 1), lambda x: 'outlink: ' || regexp_replace(x, '[\r\n]+', ' ', 'g'))), chr(13) || chr(10)) || chr(13) || chr(10) AS block
    FROM t6 UNION ALL
  SELECT page_id, url, rid, {base32('html')}, 'conversion', 'text/plain; charset=utf-8', regexp_replace(t6, '^[ \n]+|[ \n]+$', '', 'g') FROM t6)
SELECT page_id, warc_type, CASE warc_type WHEN 'metadata' THEN {uuid('metadata', 'rid')} ELSE {uuid('conversion', 'rid')} END AS record_id, rid AS refers_to,
    url AS target_uri, content_type, strlen(block) AS content_length, {base32('block')} AS block_digest, payload_digest AS source_payload_digest, block FROM body"""


@register("op1_warc_derivatives", _sql())
def op1_warc_derivatives(spark, sf_dir):
    out = derive(responses_of(load_table(spark, sf_dir, "pages"), CAPTURED), DERIVED)
    return out.select(F.col("source_page_id").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length",
                      "block_digest", "source_payload_digest", "block")

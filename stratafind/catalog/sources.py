"""Queries of file loaders and of cleaning that a provider does: documents are rendered as files and read back."""

from pyspark.sql import functions as F

from .. import providers as P
from ..functions import text as X
from ..operators import chunking, files
from ..registry import query
from ..sources import documents as D
from .text import cleaning, decorated, paths, FILES, SQL_TEXT

# ---- text, PDF, Word, pictures

TITLE = "upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || ' My Doc ' || doc_id || '.V2'"
query("src_text", f"SELECT path, text, {TITLE} AS title, source AS category FROM {FILES}")(
    lambda t, _: files.load_text(paths(t("documents")).select("path", F.encode("text", "UTF-8").alias("content"))).select("path", "text", "title", "category")
)
#: Letters that the rendered files hold; all others become a question mark on both sides.
PLAIN = "[^\\x0a -~¡-ÿ]"
PER_PAGE = 40
TIDY = f"regexp_replace(regexp_replace(text, '{PLAIN}', ' ', 'g'), ' +', ' ', 'g')"
LINES = f"list_filter(list_transform(string_split({TIDY}, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '')"


def lines(c):
    tidy = F.regexp_replace(F.regexp_replace(c, PLAIN, " "), " +", " ")
    return F.filter(F.transform(F.split(tidy, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def as_pdfs(t):
    return D.rendered(t("documents").select(F.col("doc_id").cast("string").alias("path"), lines(F.col("text")).alias("lines")), lambda ls: D.as_pdf(list(ls), PER_PAGE), ["path", "lines"])


@query("src_pdf", f"""SELECT doc_id::VARCHAR AS path, p::INT AS page_number, pages::INT AS total_pages, '[Page ' || p || ']' || chr(10) || array_to_string(list_slice(ls, (p - 1) * {PER_PAGE} + 1, p * {PER_PAGE}), chr(10)) AS text
    FROM (SELECT doc_id, ls, pages, unnest(range(1, pages + 1)) AS p FROM (SELECT doc_id, ls, greatest(1, (len(ls) + {PER_PAGE - 1}) // {PER_PAGE}) AS pages FROM (SELECT doc_id, {LINES} AS ls FROM documents)))""")
def src_pdf(t, _):
    return D.load_pdf(as_pdfs(t)).select("path", "page_number", "total_pages", "text")


def word(heading, ls, lang, n):
    return D.as_docx([("text", "Preamble")] + [("heading", heading)] + [("text", x) for x in ls] + [("table", [["lang", "chars"], [lang, str(n)]])])


@query("src_docx", f"""SELECT doc_id::VARCHAR AS path, k AS ord, CASE k WHEN 0 THEN '' ELSE source END AS section_title, source AS sections,
    CASE k WHEN 0 THEN 'Preamble' ELSE array_to_string(list_concat(ls, ['[TABLE]' || chr(10) || '| lang | chars |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || n_chars || ' |' || chr(10) || '[/TABLE]']), chr(10)) END AS text
    FROM (SELECT *, {LINES} AS ls FROM documents), (VALUES (0), (1)) v(k)""")
def src_docx(t, _):
    rows = t("documents").select(F.col("doc_id").cast("string").alias("path"), "source", lines(F.col("text")).alias("lines"), "lang", "n_chars")
    return D.load_docx(D.rendered(rows, word, ["path", "source", "lines", "lang", "n_chars"]))


def seen(data, page):
    """The stand-in for a recogniser: pictures are texts, of which it reads the first 60 bytes; the blank it cannot read."""
    return data[:60].decode("utf-8", "ignore").strip()


pictures = lambda t: t("benchmark").select(F.col("item_id").cast("string").alias("path"), F.encode(F.regexp_replace("text", "[^\\x00-\\x7f]", "?"), "UTF-8").alias("content"))
ASCII = "regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g')"
SEEN = f"regexp_replace(substr({ASCII}, 1, 60), '^\\s+|\\s+$', '', 'g')"
query("src_image_ocr", f"SELECT item_id::VARCHAR AS path, 1 AS page_number, {SEEN} <> '' AS used_ocr, '[Page 1]' || chr(10) || {SEEN} AS text FROM benchmark")(lambda t, _: D.load_image(pictures(t), seen))


def describe(data):
    if len(data) % 2:
        raise RuntimeError("no picture")
    return f"{len(data)} bytes"


query("src_vision", "SELECT item_id::VARCHAR AS path, CASE WHEN length(text) % 2 = 1 THEN '' ELSE length(text) || ' bytes' END AS description FROM benchmark")(lambda t, _: D.described(pictures(t), describe))

# ---- headings, encoding, batches

HEADED = "'# Intro' || chr(10) || 'A' || chr(10) || '[Page 2]' || chr(10) || '## ' || source || ' part' || chr(10) || text || chr(10) || 'SOME HEADING' || chr(10) || '# Intro' || chr(10)"
HEADINGS = r"regexp_extract_all(x, '(?m)^(?:#{1,3}\s+.+|[A-Z][A-Z\s]{3,59}[A-Z])$')"


@query("src_detect_sections", rf"SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(h, lambda v: [lpad(list_position(h, v)::VARCHAR, 6, '0'), v]))), lambda z: z[2]), '|') AS sections FROM (SELECT doc_id, list_transform({HEADINGS}, lambda v: regexp_replace(regexp_replace(v, '^[#\s]+', ''), '^\s+|\s+$', '', 'g')) AS h FROM (SELECT doc_id, {HEADED} AS x FROM documents))")
def src_detect_sections(t, _):
    headed = F.concat(F.lit("# Intro\nA\n[Page 2]\n## "), "source", F.lit(" part\n"), "text", F.lit("\nSOME HEADING\n# Intro\n"))
    return t("documents").select("doc_id", F.array_join(X.headings(headed), "|").alias("sections"))


BROKEN = "'cafÃ© Ã¼ber Â£5 Ã±o ' || text"
FIXED = BROKEN.replace("text", "text", 1)
for lead, chars in X.TWICE:
    for broken, whole in chars:
        FIXED = f"replace({FIXED}, '{broken}', '{whole}')"
query("cln_mojibake", f"SELECT doc_id, {FIXED} AS text FROM documents")(lambda t, _: t("documents").select("doc_id", X.unmangled(F.concat(F.lit("cafÃ© Ã¼ber Â£5 Ã±o "), "text")).alias("text")))
query("cln_batch", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM (SELECT doc_id, " + SQL_TEXT + " AS text FROM documents)")(lambda t, _: decorated(t("documents")).select("doc_id", X.no_control(F.col("text")).alias("text")))

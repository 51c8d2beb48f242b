"""Text queries: prose from pages, chunks, repeated messages, vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vegaflow.functions.numeric import js_round
from vegaflow.operators.search import nearest_rows
from vegaflow.plans.registry import SQL, query
from vegaflow.sources.fixtures import MACRO_SQL, macro_events, sql_round, table

#: A page as pieces: tags, runs of text, and signs that open no tag.
PIECE, TAG_NAME, COMMENT = "<[^<>]*>|[^<]+|<", "^<(/?[A-Za-z][A-Za-z0-9]*)[^<>]*>$", "<!--[\\s\\S]*?-->"
#: Elements without prose: what raw ones hold is no markup, so they are settled before the others.
RAW, APART = ("head", "script", "style"), ("nav", "footer", "svg")
#: What a tag stands for in prose: the level of a heading in marks, an end of a paragraph, an end of a line.
HEADINGS = {f"h{n}": "\n\n" + "#" * max(2, n) + " " for n in range(1, 7)}
ENDS = {"/" + t: "\n\n" for t in ("p", "div", "section", "article", "li", "tr", *HEADINGS)} | {"br": "\n"}
#: References that prose may hold, in the order in which they are read.
REFERENCES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
#: What is left to tidy: other numbered references, blanks, and more than one empty line.
TIDY = (("&#[0-9]+;", ""), ("[ \\t]+", " "), ("\\n\\s*\\n\\s*\\n", "\n\n"), ("^\\s+|\\s+$", ""))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inside_sql(names: tuple[str, ...]) -> str:
    before, behind = "PARTITION BY page_id ORDER BY i", "PARTITION BY page_id ORDER BY i DESC"
    last = lambda tag, w: f"max(i) FILTER (tag = '{tag}') OVER ({w})"
    one = lambda n: f"coalesce({last(n, before)} > coalesce({last('/' + n, before)}, -1), false) AND min(i) FILTER (tag = '/{n}') OVER ({behind}) IS NOT NULL"
    return " OR ".join(f"({one(n)})" for n in names)


def prose_sql() -> str:
    marks = " ".join(f"WHEN '{t}' THEN {quoted(m)}" for t, m in (HEADINGS | ENDS).items())
    heads = lambda slash: ", ".join(f"'{slash}{h}'" for h in HEADINGS)
    text = "string_agg(piece, '' ORDER BY i)"
    for sign, out in REFERENCES:
        text = f"replace({text}, {quoted(sign)}, {quoted(out)})"
    for pattern, out in TIDY:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(out)}, 'g')"
    return f"""cut AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{COMMENT}', '', 'g'), '{PIECE}') AS l FROM pages),
piece AS (SELECT page_id, unnest(l) AS piece, unnest(generate_series(1, len(l))) AS i FROM cut), tagged AS (SELECT *, lower(regexp_extract(piece, '{TAG_NAME}', 1)) AS tag, piece LIKE '<%>' AS is_tag FROM piece),
raw AS (SELECT * FROM tagged QUALIFY NOT ({inside_sql(RAW)})), shown AS (SELECT * FROM raw QUALIFY NOT ({inside_sql(APART)})),
said AS (SELECT page_id, i, CASE WHEN is_tag THEN coalesce(CASE tag {marks} END, '') ELSE regexp_replace(regexp_replace(piece, CASE WHEN lag(tag, 1, '') OVER w IN ({heads('')}) THEN '^\\s+' ELSE '^$' END, ''), CASE WHEN lead(tag, 1, '') OVER w IN ({heads('/')}) THEN '\\s+$' ELSE '^$' END, '') END AS piece FROM shown WINDOW w AS (PARTITION BY page_id ORDER BY i)),
p AS (SELECT page_id, {text} AS prose FROM said GROUP BY 1)"""


def prose(pages: DataFrame) -> DataFrame:
    """page_id, prose of every row: text with headings as marks and paragraphs apart; empty where there is none.

    A page is walked once as rows of pieces; what is shown, and what a tag stands
    for, comes from the rows around it in the page's window.
    """
    w = Window.partitionBy("row").orderBy("i")
    before, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = lambda tag, f, frame: f(F.when(F.col("tag") == tag, F.col("i"))).over(frame)

    def outside(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        hidden = F.lit(False)
        for n in names:
            opened = F.coalesce(at(n, F.max, before) > F.coalesce(at("/" + n, F.max, before), F.lit(-1)), F.lit(False))
            hidden = hidden | (opened & at("/" + n, F.min, behind).isNotNull())
        return df.withColumn("hidden", hidden).where("not hidden").drop("hidden")

    pieces = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), F.lit(COMMENT), F.lit("")), F.lit(PIECE), 0)
    # one empty piece at the end, which nothing hides: every page has a row
    x = pages.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", F.posexplode(F.array_append(pieces, "")).alias("i", "piece"))
    x = x.withColumns({"tag": F.lower(F.regexp_extract("piece", TAG_NAME, 1)), "is_tag": F.col("piece").startswith("<") & F.col("piece").endswith(">")})
    x = outside(outside(x, RAW), APART)
    after_head, before_end = F.lag("tag", 1, "").over(w).isin(*HEADINGS), F.lead("tag", 1, "").over(w).isin(*("/" + h for h in HEADINGS))
    mark = F.coalesce(F.create_map(*(F.lit(v) for kv in (HEADINGS | ENDS).items() for v in kv))[F.col("tag")], F.lit(""))
    x = x.withColumns({"after_head": after_head, "before_end": before_end})
    bare = F.when(F.col("after_head"), F.regexp_replace("piece", "^\\s+", "")).otherwise(F.col("piece"))
    bare = F.when(F.col("before_end"), F.regexp_replace(bare, "\\s+$", "")).otherwise(bare)
    x = x.withColumn("out", F.when(F.col("is_tag"), mark).otherwise(bare))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("i", "out")))["out"], "")
    g = x.groupBy("row", "page_id").agg(text.alias("prose"))
    c = F.col("prose")
    for sign, out in REFERENCES:
        c = F.replace(c, F.lit(sign), F.lit(out))
    for pattern, out in TIDY:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(out))
    return g.select("page_id", c.alias("prose"))


@query(f"WITH {prose_sql()} SELECT page_id, coalesce(prose, '') AS prose, sha256(coalesce(prose, '')) AS content_hash, CAST(ceil(length(coalesce(prose, '')) / 4e0) AS BIGINT) AS token_estimate FROM pages LEFT JOIN p USING (page_id)")
def html_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of pages with headings as marks, its hash and a token estimate; a page without any has an empty one."""
    p = prose(table(spark, sf_dir, "pages"))
    return p.select("page_id", "prose", F.sha2("prose", 256).alias("content_hash"), F.ceil(F.length("prose") / F.lit(4.0)).alias("token_estimate"))


#: Every tenth conversation's questions are asked once more by somebody else, so that there are repeats.
ASKED_SQL = "asked AS (SELECT conv_id, role, text FROM conversations UNION ALL SELECT conv_id + 1000000, role, text FROM conversations WHERE conv_id % 10 = 0)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "text")
    return c.unionAll(c.where("conv_id % 10 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000))


NORM_SQL = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH {ASKED_SQL}, c AS (SELECT conv_id, {NORM_SQL} AS message, text FROM asked WHERE role = 'user') SELECT message, count(*) AS times, count(DISTINCT conv_id) AS askers FROM c WHERE length(message) >= 4 GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT conv_id) >= 2""")
def repeated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages that are alike once normalised and come from two conversations at least."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", " "), r"\s+", " "))
    c = asked(spark, sf_dir).where("role = 'user'").select("conv_id", norm.alias("message")).where(F.length("message") >= 4)
    return c.groupBy("message").agg(F.count("*").alias("times"), F.countDistinct("conv_id").alias("askers")).where("times >= 2 and askers >= 2")


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) > 240 THEN substring(t, 1, 240) || '…' ELSE t END AS snippet FROM t""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 240 characters of each text in one line; null where there are none."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    return t.select("doc_id", F.when(F.col("t") == "", None).when(F.length("t") > 240, F.concat(F.substring("t", 1, 240), F.lit("…"))).otherwise(F.col("t")).alias("snippet"))


FAMILIES = (("license", "licensed under|copyright|license"), ("contact", "@|phone|email"), ("secret", "token|password|api[_ ]key"), ("number", "[0-9]{4,}"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in FAMILIES) + " ELSE 'other' END AS family FROM documents")
def keyword_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First keyword family that a text falls into."""
    c = None
    for name, pattern in FAMILIES:
        hit = F.lower("text").rlike(pattern)
        c = F.when(hit, name) if c is None else c.when(hit, name)
    return table(spark, sf_dir, "documents").select("doc_id", c.otherwise("other").alias("family"))


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(qe, e) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(e, e))) AS sim FROM q, v WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s WHERE sim >= 0.2e0)
SELECT query_id, vec_id, {sql_round('sim', 6)} AS similarity, place FROM r WHERE place <= 6""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six rows nearest to each query vector by cosine, above a floor; queries are the rows whose id 20 divides."""
    v = table(spark, sf_dir, "embeddings")
    r = nearest_rows(v, v.where("vec_id % 20 = 0"), 6, 0.2)
    return r.select("query_id", F.col("id").alias("vec_id"), js_round(F.col("similarity"), 6).alias("similarity"), "place")


@query(f"""WITH q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0), best AS (SELECT query_id, similarity FROM ({SQL['vector_search']}) WHERE place = 1)
SELECT CASE WHEN similarity IS NULL OR similarity < 0.5e0 THEN 'gap' WHEN similarity < 0.75e0 THEN 'weak' ELSE 'good' END AS bucket, count(*) AS queries, count(*) FILTER (query_id % 7 = 0) AS fallbacks, count(*) FILTER (query_id % 11 = 0) AS errors FROM q LEFT JOIN best USING (query_id) GROUP BY 1""")
def similarity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by how near their best answer is; ids stand for what went to another tool or failed."""
    q = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    best = vector_search(spark, sf_dir).where("place = 1").select("query_id", "similarity")
    x = F.col("similarity")
    bucket = F.when(x.isNull() | (x < 0.5), "gap").when(x < 0.75, "weak").otherwise("good")
    return q.join(best, "query_id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("queries"), F.count_if(F.col("query_id") % 7 == 0).alias("fallbacks"), F.count_if(F.col("query_id") % 11 == 0).alias("errors"))


#: Longest words of a question that an answer must hold all of, and answers to a question.
TERMS, ANSWERS = 3, 6


@query(f"""WITH w AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark), t AS (SELECT item_id, term FROM w WHERE length(term) >= 4 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) <= {TERMS}),
d AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS n FROM d WHERE term IN (SELECT term FROM t) GROUP BY 1, 2),
h AS (SELECT item_id, doc_id, count(*) AS terms, CAST(sum(n) AS BIGINT) AS hits FROM t JOIN f USING (term) GROUP BY 1, 2)
SELECT item_id, doc_id, hits, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS place FROM h WHERE terms = (SELECT count(*) FROM t k WHERE k.item_id = h.item_id) QUALIFY place <= {ANSWERS}""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question falls back on without a near vector: the documents that hold all its terms, most hits first.

    Only words that are a term of some question leave a document, added up before they are joined.
    """
    words = lambda c: F.split(F.lower(c), "[^a-z]+")
    order = Window.partitionBy("item_id").orderBy(F.desc(F.length("term")), "term")
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).where(F.length("term") >= 4)
    t = t.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= TERMS).select("item_id", "term")
    asked_for = t.groupBy("item_id").agg(F.count("*").alias("wanted"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("term"))
    f = d.join(t.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    h = t.join(f, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("terms"), F.sum("n").alias("hits")).join(asked_for, "item_id").where("terms = wanted")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))
    return h.withColumn("place", place).where(F.col("place") <= ANSWERS).select("item_id", "doc_id", "hits", "place")


#: How a source file may hold a text: between the back-ticks of an export.
TEMPLATE = "export\\s+(?:default|const\\s+\\w+\\s*=)\\s*`([^`]*)`"


@query(f"""WITH s AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'import x;' || chr(10) || 'export default `  ' || url || chr(10) || '`;' WHEN 1 THEN 'export const prompt = `' || url || '`' ELSE url END AS raw FROM pages)
SELECT page_id, CASE WHEN regexp_matches(raw, '{TEMPLATE}') THEN trim(regexp_extract(raw, '{TEMPLATE}', 1), ' ' || chr(10)) ELSE raw END AS template FROM s""")
def template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a source file exports, else the whole file."""
    url = F.col("url")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("import x;\nexport default `  "), url, F.lit("\n`;"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("export const prompt = `"), url, F.lit("`"))).otherwise(url)
    s = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"))
    return s.select("page_id", F.when(F.col("raw").rlike(TEMPLATE), F.trim(F.regexp_extract("raw", TEMPLATE, 1), F.lit(" \n"))).otherwise(F.col("raw")).alias("template"))


#: Families of macro titles, first match wins (ignoring case).
FAMILIES_OF_TITLES = (
    ("FOMC", r"\bFOMC\b|Federal Funds Rate"), ("CPI", r"\bCPI\b|Consumer Price"), ("NFP", r"Non[- ]?Farm Employment Change|^NFP$"), ("GDP", r"\bGDP\b"), ("PCE", r"\bPCE\b"), ("PPI", r"\bPPI\b"), ("ISM", r"\bISM\b"), ("JOBS", "Unemployment Claims|Employment Change|Job Openings"),
)


@query(f"""WITH {MACRO_SQL}, t AS (SELECT event_id, CASE WHEN regexp_matches(title, '^[A-Z]{{2,3}}\\s+.') THEN regexp_replace(title, '^[A-Z]{{2,3}}\\s+', '') ELSE title END AS title, impact FROM macro)
SELECT event_id, title, CASE WHEN impact IS NOT NULL THEN upper(impact[1]) || lower(impact[2:]) END AS impact, CASE {' '.join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{n}'" for n, p in FAMILIES_OF_TITLES)} END AS family FROM t""")
def event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro titles without a leading country code, their impact with a capital, and the family they belong to (null: none)."""
    code = r"^[A-Z]{2,3}\s+"
    t = macro_events(spark, sf_dir).withColumn("title", F.when(F.col("title").rlike(code + "."), F.regexp_replace("title", code, "")).otherwise(F.col("title")))
    family = None
    for name, pattern in FAMILIES_OF_TITLES:
        hit = F.col("title").rlike("(?i)" + pattern)
        family = F.when(hit, name) if family is None else family.when(hit, name)
    impact = F.concat(F.upper(F.substring("impact", 1, 1)), F.lower(F.substring("impact", 2, 100)))
    return t.select("event_id", "title", impact.alias("impact"), family.alias("family"))


#: Characters of a section that start a new chunk, of a section or paragraph that is left whole, and of the chunk before that a chunk repeats.
STRIDE, WHOLE, OVERLAP = 1500, 2500, 200
#: Signs that no text holds; they mark where to cut, as a plain split is the same everywhere.
CUT, PART = "\x1e", "\x1f"
CUTS = ((r"(?m)^(#{2,3}[ \t]+[^ \t\r\n])", CUT), (r"\n[ \t\r]*\n[ \t\r\n]*", PART), (r"([.!?])[ \t\r\n]+([A-Z])", PART))
EDGES, HEAD = r"^[ \t\r\n]+|[ \t\r\n]+$", r"^#{2,3}[ \t]+[^\n]*"

CHUNKS_SQL = f"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '{CUTS[0][0]}', chr(30) || '\\1', 'g'), chr(30))) AS part, generate_subscripts(string_split(regexp_replace(text, '{CUTS[0][0]}', chr(30) || '\\1', 'g'), chr(30)), 1) AS section FROM documents),
b AS (SELECT doc_id, section, regexp_extract(part, '{HEAD}') AS heading, regexp_replace(substring(part, length(regexp_extract(part, '{HEAD}')) + 1), '{EDGES}', '', 'g') AS body FROM s),
p AS (SELECT doc_id, section, heading, unnest(CASE WHEN length(body) <= {WHOLE} THEN [body] ELSE string_split(regexp_replace(body, '{CUTS[1][0]}', chr(31), 'g'), chr(31)) END) AS paragraph, generate_subscripts(CASE WHEN length(body) <= {WHOLE} THEN [body] ELSE string_split(regexp_replace(body, '{CUTS[1][0]}', chr(31), 'g'), chr(31)) END, 1) AS i FROM b WHERE body <> ''),
u AS (SELECT doc_id, section, heading, i, unnest(CASE WHEN length(paragraph) <= {WHOLE} THEN [paragraph] ELSE string_split(regexp_replace(paragraph, '{CUTS[2][0]}', '\\1' || chr(31) || '\\2', 'g'), chr(31)) END) AS unit, generate_subscripts(CASE WHEN length(paragraph) <= {WHOLE} THEN [paragraph] ELSE string_split(regexp_replace(paragraph, '{CUTS[2][0]}', '\\1' || chr(31) || '\\2', 'g'), chr(31)) END, 1) AS j FROM p),
k AS (SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id, section ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {STRIDE} AS place FROM u WHERE regexp_replace(unit, '{EDGES}', '', 'g') <> ''),
g AS (SELECT doc_id, section, heading, place, string_agg(unit, chr(10) ORDER BY i, j) AS text FROM k GROUP BY ALL),
c AS (SELECT doc_id, section, place, CASE WHEN heading <> '' THEN heading || chr(10) || chr(10) ELSE '' END || coalesce(right(lag(text) OVER (PARTITION BY doc_id, section ORDER BY place), {OVERLAP}) || chr(10), '') || text AS content FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, place) - 1 AS chunk_index, content, sha256(content) AS content_hash, CAST(ceil(length(content) / 4e0) AS BIGINT) AS token_estimate FROM c"""


def chunks(texts: DataFrame) -> DataFrame:
    """Chunks of (doc_id, text): doc_id, chunk_index, content.

    A text is cut at level-two and level-three headings. A section of up to
    ``WHOLE`` characters is one chunk; a longer one falls into paragraphs, and
    those of over ``WHOLE`` characters into sentences, and the units that start
    within the same ``STRIDE`` of it make a chunk. Every chunk has its section's
    heading and the end of the chunk before. The places come from running
    lengths, so a text of any length is cut by windows, not by a loop.
    """
    split_at = lambda c, cut, out, sign: F.split(F.regexp_replace(c, F.lit(cut[0]), F.lit(out)), sign)
    s = texts.select("doc_id", F.posexplode(split_at(F.col("text"), CUTS[0], CUT + "$1", CUT)).alias("section", "part"))
    heading = F.regexp_extract("part", HEAD, 0)
    b = s.select("doc_id", "section", heading.alias("heading"), F.regexp_replace(F.substring("part", F.length(heading) + 1, F.length("part")), EDGES, "").alias("body")).where("body <> ''")
    unless_long = lambda c, parts: F.when(F.length(c) <= WHOLE, F.array(c)).otherwise(parts)
    p = b.select("doc_id", "section", "heading", F.posexplode(unless_long(F.col("body"), split_at(F.col("body"), CUTS[1], PART, PART))).alias("i", "paragraph"))
    u = p.select("doc_id", "section", "heading", "i", F.posexplode(unless_long(F.col("paragraph"), split_at(F.col("paragraph"), CUTS[2], f"$1{PART}$2", PART))).alias("j", "unit")).where(F.regexp_replace("unit", EDGES, "") != "")
    before = Window.partitionBy("doc_id", "section").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1)
    k = u.withColumn("place", F.floor(F.coalesce(F.sum(F.length("unit")).over(before), F.lit(0)) / F.lit(STRIDE)))
    units = F.array_sort(F.collect_list(F.struct("i", "j", "unit")))
    g = k.groupBy("doc_id", "section", "heading", "place").agg(F.array_join(units["unit"], "\n").alias("text"))
    last = F.lag("text").over(Window.partitionBy("doc_id", "section").orderBy("place"))
    lead = F.when(F.col("heading") != "", F.concat("heading", F.lit("\n\n"))).otherwise("")
    c = g.withColumn("content", F.concat(lead, F.coalesce(F.concat(F.right(last, F.lit(OVERLAP)), F.lit("\n")), F.lit("")), F.col("text")))
    return c.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "place")) - 1).alias("chunk_index"), "content")


@query(CHUNKS_SQL)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents with their place, hash and token estimate."""
    c = chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.withColumns({"content_hash": F.sha2("content", 256), "token_estimate": F.ceil(F.length("content") / F.lit(4.0))})


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'delete' WHEN o.doc_id IS NULL THEN 'insert' WHEN o.h <> n.h THEN 'update' ELSE 'skip' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def chunk_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync of stored texts does: unchanged hashes are skipped, orphans deleted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    o = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h_old"))
    n = d.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")), 256).alias("h_new"))
    action = F.when(F.col("h_new").isNull(), "delete").when(F.col("h_old").isNull(), "insert").when(F.col("h_old") != F.col("h_new"), "update").otherwise("skip")
    return o.join(n, "doc_id", "full_outer").select("doc_id", action.alias("action"))

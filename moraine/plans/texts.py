"""Scalar functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import text as T
from moraine.plans.registry import query, table


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def has_any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def terms_sql(text: str) -> str:
    """The distinct terms that overlap is counted on."""
    synonyms = "MAP {" + ", ".join(f"'{w}': {quoted(' '.join(s).split())}" for w, s in T.SYNONYMS.items()) + "}"
    words = words_sql(rf"lower(regexp_replace({text}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'))")
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda w: list_concat([w], coalesce({synonyms}[w], [])))), lambda w: NOT list_contains({quoted(T.STOPWORDS)}, w) AND length(w) > 2))"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"


_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NORMAL = _SQUEEZE.format(r"regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g')")
_EDGE, _END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


@query(f"SELECT doc_id, {_NORMAL} AS normal FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


#: The driver's questions name no places, so one is put to the front and the end of each.
_ASKED = "concat('Apa saja syarat di Kota Medan: ', text, ' di medan')"


@query(f"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace({_ASKED}, '(?i)\\bdi\\s+kota\\s+medan\\b', '', 'g'), '(?i)\\bdi\\s+medan\\b', '', 'g')) AS cleaned FROM conversations WHERE role = 'user'""")
def clean_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.clean_location(F.expr(_ASKED)).alias("cleaned"))


@query(f"""SELECT conv_id, turn, role, coalesce({', '.join(f"CASE WHEN regexp_matches(lower(text), '{_EDGE}{w}{_END}') THEN 'outside:{w}' END" for w in T.OUTSIDE)},
  CASE WHEN regexp_matches(lower(text), '{_EDGE}({'|'.join(T.OPINIONS)}){_END}') THEN 'opinion' WHEN len({words_sql('lower(text)')}) <= 1 THEN 'short' END) AS refused FROM conversations""")
def hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a question is refused before any search."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.hard_filter(F.col("text")).alias("refused"))


_CATEGORY = "coalesce(" + ", ".join(f"CASE WHEN {has_any_sql('lower(text)', words)} THEN '{i}' END" for i, _, words in T.CATEGORIES) + ")"


@query(f"SELECT doc_id, {_CATEGORY} AS category_id, {has_any_sql('lower(text)', T.ADMINISTRATIVE)} AS administrative FROM documents")
def detect_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category by the first list with a word that the text holds, and whether it is about administration."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.category_id(F.col("text")).alias("category_id"), T.is_administrative(F.col("text")).alias("administrative"))


@query("WITH names(category_id, name) AS (VALUES " + ", ".join(f"('{i}', '{n}')" for i, n, _ in T.CATEGORIES) + f") SELECT coalesce(name, 'none') AS category, count(*) AS documents FROM (SELECT {_CATEGORY} AS category_id FROM documents) LEFT JOIN names USING (category_id) GROUP BY 1")
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in a dimension of constant size: documents per category name."""
    names = F.broadcast(spark.createDataFrame([(i, n) for i, n, _ in T.CATEGORIES], "category_id string, name string"))
    d = table(spark, sf_dir, "documents").select(T.category_id(F.col("text")).alias("category_id"))
    return d.join(names, "category_id", "left").groupBy(F.coalesce("name", F.lit("none")).alias("category")).agg(F.count("*").alias("documents"))


@query(f"SELECT doc_id, len({terms_sql('text')})::INTEGER AS terms FROM documents")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms are left of a text with synonyms and without stop words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.key_terms(F.col("text"))).alias("terms"))


@query(f"""WITH q AS (SELECT conv_id, turn, {terms_sql('text')} AS a FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, {terms_sql('text')} AS b FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, round({jaccard_sql('a', 'b')}, 6) AS overlap, round(0.65 * 0.8 + 0.35 * {jaccard_sql('a', 'b')}, 3) AS final_score FROM q JOIN r USING (conv_id, turn)""")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each question with the answer after it, and the score at a dense score of 0.8."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", T.key_terms(F.col("text")).alias("a"))
    r = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), T.key_terms(F.col("text")).alias("b"))
    overlap = T.jaccard(F.col("a"), F.col("b"))
    return q.join(r, ["conv_id", "turn"]).select("conv_id", "turn", F.round(overlap, 6).alias("overlap"), T.final_score(F.lit(0.8), overlap).alias("final_score"))


_TOKENS = r"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(len(" + words_sql("text") + r"), length(text) // 3) END"


@query(f"SELECT doc_id, ({_TOKENS})::INTEGER AS tokens, len(list_filter(string_split_regex(text, '\\n\\n'), lambda p: trim(p) <> ''))::INTEGER AS paragraphs, length(text)::INTEGER AS content_length FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    paragraphs = F.size(F.filter(F.split("text", "\n\n"), lambda p: F.trim(p) != ""))
    return d.select("doc_id", T.estimate_tokens(F.col("text")).cast("int").alias("tokens"), paragraphs.alias("paragraphs"), F.length("text").alias("content_length"))


_HASH = "sha256(" + _SQUEEZE.format("lower(trim(text))") + ")"


@query(f"SELECT doc_id, {_HASH} AS content_hash, sha256(text) AS raw_hash, sha256(concat_ws(chr(10), source, lang, text)) AS item_hash, md5('document:' || doc_id) AS doc_md5 FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes that changes are found by: of documents, pages and items of parts; and the id of a vector point."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.sha2("text", 256).alias("raw_hash"), T.item_hash(F.col("source"), F.col("lang"), F.col("text")).alias("item_hash"), F.md5(F.concat(F.lit("document:"), F.col("doc_id").cast("string"))).alias("doc_md5"))


@query(f"SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, {_HASH} AS content_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are there more than once, but for case and white space."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\n\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS shown,
  trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \t]*\d{1,4}[ \t]*$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM documents""")
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for display, and pages without their numbers."""
    return table(spark, sf_dir, "documents").select("doc_id", T.display(F.col("text")).alias("shown"), T.clean_page(F.col("text")).alias("cleaned"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS n FROM documents)"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(f"""WITH {_LINES}, kept AS (SELECT *, trim(line) AS t, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM lines WHERE trim(line) <> '')
SELECT doc_id, n, t AS line FROM kept WHERE before IS NULL OR t <> before""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ from the line before, blank ones left out."""
    from pyspark.sql import Window

    own = lines_of(spark, sf_dir).withColumn("t", F.trim("line")).where("t <> ''")
    before = F.lag("t").over(Window.partitionBy("doc_id").orderBy("n"))
    return own.withColumn("before", before).where("before IS NULL OR t <> before").select("doc_id", "n", F.col("t").alias("line"))


_HEADING = r"""(length(trim(line)) > 0 AND length(trim(line)) <= 120 AND (regexp_matches(trim(line), '(?i)^(bab|bagian|pasal)([^\p{L}\p{N}_]|$)')
  OR (NOT regexp_matches(trim(line), '[.?!;:]$') AND ((length(regexp_replace(trim(line), '[^\p{L}]', '', 'g')) > 0 AND regexp_replace(trim(line), '[^\p{L}]', '', 'g') = upper(regexp_replace(trim(line), '[^\p{L}]', '', 'g')) AND len(""" + words_sql("trim(line)") + """) <= 10)
  OR (len(""" + words_sql("trim(line)") + """) <= 8 AND len(list_filter(""" + words_sql("trim(line)") + r""", lambda w: NOT regexp_matches(w, '^\p{Lu}'))) = 0)))))"""


@query(f"""WITH {_LINES} SELECT doc_id, n, {_HEADING} AS heading,
  CASE WHEN starts_with(lower(trim(line)), 'bab') THEN 1 WHEN starts_with(lower(trim(line)), 'bagian') THEN 2 WHEN starts_with(lower(trim(line)), 'pasal') THEN 3 ELSE 2 END AS level,
  (len(regexp_extract_all(line, '\\p{{L}}')) >= 4 AND len(regexp_extract_all(line, '\\p{{Lu}}'))::DOUBLE / len(regexp_extract_all(line, '\\p{{L}}')) >= 0.72) AS upper_heading,
  regexp_replace(lower({_SQUEEZE.format('line')}), '\\d+', '#', 'g') AS noise_key FROM lines""")
def line_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line reads like a heading, by two rules, with its level and its key for repeated noise."""
    line = F.col("line")
    return lines_of(spark, sf_dir).select("doc_id", "n", T.is_heading(line).alias("heading"), T.heading_level(line).alias("level"), T.upper_ratio_heading(line).alias("upper_heading"), T.noise_key(line).alias("noise_key"))


@query(f"""WITH {_LINES}, marked AS (SELECT doc_id, n, CASE WHEN {_HEADING} THEN trim(line) END AS heading FROM lines)
SELECT doc_id, n, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS heading FROM marked""")
def heading_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that each line stands under, on one level."""
    from pyspark.sql import Window

    own = lines_of(spark, sf_dir).withColumn("own", F.when(T.is_heading(F.col("line")), F.trim("line")))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("doc_id", "n", F.last("own", ignorenulls=True).over(w).alias("heading"))


_LEAKS = [r"(^|[^\p{L}\p{N}_])rule\s+\d+\s*:", r"(^|[^\p{L}\p{N}_])if\s+not\s+found($|[^\p{L}\p{N}_])", r"(^|[^\p{L}\p{N}_])aturan\s+ketat($|[^\p{L}\p{N}_])", r"(^|[^\p{L}\p{N}_])referensi\s+teks($|[^\p{L}\p{N}_])"]
_REPLIES = "VALUES ('Tidak ditemukan.'), ('Rule 2: ikuti'), ('maaf, belum ada'), ('   '), ('tidak ada data untuk itu'), ('')"
_ANSWERS = f"""answers AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT -row_number() OVER (), 0, t FROM ({_REPLIES}) v(t))"""


@query(f"""WITH {_ANSWERS} SELECT text, count(*) AS n,
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN regexp_matches(trim(text), '(?i)^tidak ditemukan([.!]|\\s|$)') THEN 'not_found'
    WHEN {' OR '.join(f"regexp_matches(trim(text), '(?i){p}')" for p in _LEAKS)} THEN 'prompt_leakage' END AS problem,
  (trim(lower(coalesce(text, ''))) = '' OR starts_with(trim(lower(coalesce(text, ''))), 'maaf') OR {' OR '.join(f"regexp_matches(trim(lower(coalesce(text, ''))), '{p}')" for p in T.NEGATIVE)}) AS negative
FROM answers GROUP BY text""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with an answer, and whether it says that nothing is known; each answer once."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("text")
    more = spark.sql(f"SELECT t AS text FROM ({_REPLIES}) v(t)")
    t = F.col("text")
    return c.unionAll(more).groupBy("text").agg(F.count("*").alias("n")).select("text", "n", T.answer_problem(t).alias("problem"), T.is_negative(t).alias("negative"))


@query(r"""SELECT conv_id, turn, CASE WHEN len(w) > 12 THEN array_to_string(w[1:12], ' ') || '...' ELSE text END AS short FROM (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations)""")
def truncated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncated_words(F.col("text")).alias("short"))


@query(r"""WITH forms AS (SELECT doc_id, unnest(['["' || lang || '", "' || source || '"]', '[''' || lang || ''']', source, '', '[]']) AS value FROM documents)
SELECT doc_id, value, array_to_string(CASE WHEN trim(value) = '' THEN []::VARCHAR[] WHEN starts_with(trim(value), '[') AND ends_with(trim(value), ']')
  THEN list_filter(list_transform(string_split(regexp_replace(trim(value), '^\[|\]$', '', 'g'), ','), lambda x: regexp_replace(trim(x), '^["'']|["'']$', '', 'g')), lambda x: x <> '')
  ELSE [regexp_replace(trim(value), '^["'']|["'']$', '', 'g')] END, '|') AS ids FROM forms""")
def answer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids as JSON, with single quotes, as one value, and empty."""
    forms = F.array(F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('"]')), F.concat(F.lit("['"), "lang", F.lit("']")), F.col("source"), F.lit(""), F.lit("[]"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(forms).alias("value"))
    return d.select("doc_id", "value", F.array_join(T.parse_answer_id(F.col("value")), "|").alias("ids"))


@query(r"""WITH named AS (SELECT doc_id, source || ' (' || lang || ') #' || doc_id || '.pdf' AS name, 'kb:city-main:document:' || source || ':' || doc_id AS ident FROM documents)
SELECT doc_id, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS filename, ident, 'city-main' AS kb, 'document' AS kind, regexp_extract(ident, '^kb:[^:]+:[a-z]+:(.+)$', 1) AS id,
  'document://' || doc_id || '/' || name AS uri, lower(regexp_extract(name, '\.([a-z]+)$', 1)) IN ('pdf', 'docx', 'xlsx', 'jpg', 'jpeg', 'png') AS allowed FROM named""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made safe, logical ids built and taken apart again, addresses, and the kinds of file that are taken."""
    name = F.concat("source", F.lit(" ("), "lang", F.lit(") #"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    d = table(spark, sf_dir, "documents").withColumn("name", name)
    d = d.withColumn("ident", T.document_id(F.lit("city-main"), F.lit("document"), F.concat_ws(":", "source", F.col("doc_id").cast("string"))))
    d = d.withColumn("p", T.parsed_document_id(F.col("ident")))
    uri = T.source_uri(F.lit("document"), F.col("doc_id").cast("string"), F.col("name"))
    return d.select("doc_id", T.sanitized_filename(F.col("name")).alias("filename"), "ident", "p.kb", F.col("p.type").alias("kind"), "p.id", uri.alias("uri"), T.allowed_file(F.col("name")).alias("allowed"))


@query(r"""WITH built AS (SELECT doc_id, 'Source-ID: document:' || doc_id || chr(10) || 'Category-ID: ' || lang || chr(10) || 'Answer-ID: ' || source || ', ' || lang || chr(10) || chr(10) || text AS content FROM documents)
SELECT doc_id, length(content)::INTEGER AS n, 'document:' || doc_id AS source_id, regexp_extract(string_split_regex(content, '\n\s*\n')[1], '(?m)^Category-ID:[ \t]*(.+?)[ \t]*$', 1) AS category_id,
  array_to_string(list_transform(string_split(regexp_extract(string_split_regex(content, '\n\s*\n')[1], '(?m)^Answer-ID:[ \t]*(.+?)[ \t]*$', 1), ','), lambda x: trim(x)), '|') AS answers FROM built""")
def ingestion_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header that a text is indexed with, built and read again."""
    d = table(spark, sf_dir, "documents")
    content = T.with_header({"Source-ID": F.concat(F.lit("document:"), F.col("doc_id").cast("string")), "Category-ID": F.col("lang"), "Answer-ID": F.concat_ws(", ", "source", "lang")}, F.col("text"))
    d = d.select("doc_id", content.alias("content"))
    answers = F.array_join(F.transform(F.split(T.header_value(F.col("content"), "Answer-ID"), ","), lambda x: F.trim(x)), "|")
    return d.select("doc_id", F.length("content").alias("n"), T.header_value(F.col("content"), "Source-ID").alias("source_id"), T.header_value(F.col("content"), "Category-ID").alias("category_id"), answers.alias("answers"))


@query("""SELECT doc_id, CASE WHEN n < 80 THEN 'penalty .12' WHEN n < 150 THEN 'penalty .07' WHEN n < 300 AND kind = 'heading' THEN 'penalty .03' ELSE 'none' END AS penalty,
  CASE WHEN score >= 0.4 AND n > 0 THEN round(greatest(0.0, score - CASE WHEN n < 80 THEN 0.12 WHEN n < 150 THEN 0.07 WHEN n < 300 AND kind = 'heading' THEN 0.03 ELSE 0.0 END), 6) END AS final_score,
  CASE WHEN score >= 0.85 THEN 'high_score' WHEN score >= 0.70 THEN 'good_score' ELSE 'marginal' END AS note
FROM (SELECT doc_id, length(trim(text)) AS n, CASE WHEN lang = 'en' THEN 'paragraph' ELSE 'heading' END AS kind, (doc_id % 101)::DOUBLE / 100 AS score FROM documents)""")
def quality_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document scores less the penalty for short texts, with notes; the dense scores are made up from the ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "paragraph").otherwise("heading").alias("kind"), ((F.col("doc_id") % 101).cast("double") / 100).alias("score"))
    n = F.length(F.trim("text"))
    label = F.when(n < 80, "penalty .12").when(n < 150, "penalty .07").when((n < 300) & (F.col("kind") == "heading"), "penalty .03").otherwise("none")
    return d.select("doc_id", label.alias("penalty"), F.round(T.quality_score(F.col("score"), F.col("text"), F.col("kind")), 6).alias("final_score"), T.document_note(F.col("score")).alias("note"))


@query(r"""SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 15)) AS term FROM documents) GROUP BY term""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text index: words of 2 to 15 characters, with how many documents have them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w).between(2, 15))).alias("term"))
    # once by document and term, so the second step shuffles no duplicates
    once = d.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("uses"))

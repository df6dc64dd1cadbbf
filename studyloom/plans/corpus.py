"""Course files, index files, chunks and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import corpus as ops, retrieval
from ..session import shared_folder
from ..sources import content, sinks
from .registry import query, table, view

_UNDER = "replace({x}, '_', ' ')"


def _title_sql(x):
    """Title case for texts of words, digits and blanks: capital after every non-letter."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({_UNDER.format(x=x)}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: concat(upper(w[1:1]), lower(w[2:]))), '')"
    )


@query(
    "scan_content_index",
    """WITH r AS (SELECT concat('m', doc_id // 20, '_set') AS module, doc_id // 20 AS n, lang AS section, concat('doc', doc_id, '.md') AS file FROM documents)
    SELECT module, section, dense_rank() OVER (PARTITION BY module ORDER BY section) - 1 AS section_pos, file,
      row_number() OVER (PARTITION BY module, section ORDER BY file) - 1 AS file_pos FROM r WHERE n % 7 NOT IN (0, 1, 2, 3)""",
)
def scan_content_index(spark, folder):
    """Index files of twenty documents each; some are broken, empty or followed by other text."""
    number = F.floor(F.col("doc_id") / 20)
    lists = (
        table(spark, folder, "documents")
        .groupBy(number.alias("n"), "lang")
        .agg(F.sort_array(F.collect_list(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")))).alias("files"))
        .groupBy("n")
        .agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "files"))))).alias("body"))
    )
    kind = F.col("n") % 7
    body = (
        F.when(kind == 0, F.lit("{broken"))
        .when(kind == 1, F.lit("{}"))
        .when(kind == 2, F.concat(F.col("body"), F.lit(" more")))
        .when(kind == 3, F.lit(""))
        .otherwise(F.col("body"))
    )
    name = F.concat(F.lit("m"), F.col("n").cast("string"), F.lit("_set_index.json"))
    root = shared_folder(spark, "index")
    sinks.write_files(lists.select(name.alias("path"), body.alias("value")), root)
    return content.read_content_index(spark, root)


_PAGE_FILE = """CASE page_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.IPYNB' WHEN 2 THEN '.Png' ELSE '.html' END"""


@query(
    "scan_content_files",
    f"""SELECT concat('page', page_id, {_PAGE_FILE}) AS name, concat('m', page_id % 7) AS parent, substr({_PAGE_FILE}, 2) AS type, CAST(strlen(html) + 1 AS BIGINT) AS length
    FROM pages WHERE page_id % 4 <> 3""",
)
def scan_content_files(spark, folder):
    """One file per page, ended by a line break; the .html ones must be left out."""
    parent = F.concat(F.lit("m"), (F.col("page_id") % 7).cast("string"))
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.expr(_PAGE_FILE))
    root = shared_folder(spark, "content")
    path = F.concat(parent, F.lit("/"), name)
    sinks.write_files(table(spark, folder, "pages").select(path.alias("path"), F.col("html").alias("value")), root)
    return content.read_content_files(spark, root).select("name", "parent", "type", "length")


def _file_rows(docs, kind, body):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(f".{kind}"))
    return docs.select(
        F.concat(F.lit("/data/"), F.col("lang"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.col("lang").alias("parent"),
        F.lit(kind).alias("type"),
        body.alias("content"),
    )


@query(
    "load_markdown_docs",
    "SELECT concat('doc', doc_id, '.MD') AS name, lang AS parent, concat('a', chr(10), text, chr(10)) AS text FROM documents WHERE doc_id % 9 <> 0",
)
def load_markdown_docs(spark, folder):
    """Documents as file bytes; every ninth is not UTF-8 and must be dropped."""
    text = F.concat(F.lit("a\r\n"), F.col("text"), F.lit("\r"))
    body = F.when(F.col("doc_id") % 9 == 0, F.unhex(F.lit("FFFE41"))).otherwise(F.encode(text, "UTF-8"))
    return content.load_text(_file_rows(table(spark, folder, "documents"), "MD", body)).select("name", "parent", "text")


_REPR = """CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN concat('"', {e}, '"') ELSE concat('''', replace({e}, '''', concat(chr(92), '''')), '''') END""".format(
    x="text", e="replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't'))"
)


@query(
    "load_notebook_docs",
    f"""SELECT concat('doc', doc_id, '.ipynb') AS name,
    concat('''markdown'' cell: ''[''# N', doc_id, chr(92), 'n'', ''it', ''']''', chr(10), chr(10), ' ''code'' cell: ''[', {_REPR}, ']''', chr(10), chr(10), ' ''raw'' cell: ''', lang, '''', chr(10), chr(10)) AS text
    FROM documents""",
)
def load_notebook_docs(spark, folder):
    def cell(kind, source):
        return F.concat(F.lit(f'{{"cell_type":"{kind}","source":'), source, F.lit("}"))

    head = F.concat(F.lit("# N"), F.col("doc_id").cast("string"), F.lit("\n"))
    shown = [
        cell("markdown", F.to_json(F.array(head, F.lit("it")))),
        cell("code", F.to_json(F.array(F.col("text")))),
        cell("raw", F.concat(F.lit('"'), F.col("lang"), F.lit('"'))),
    ]
    body = F.concat(F.lit('{"cells":['), F.concat_ws(",", *shown), F.lit("]}"))
    files = _file_rows(table(spark, folder, "documents"), "ipynb", F.encode(body, "UTF-8"))
    return content.load_notebooks(files).select("name", "text")


_LISTED = """listed AS (SELECT module, file AS name, min_by(section, section_pos) AS section FROM <fx_index> i GROUP BY module, file),
classified AS (SELECT f.*, CASE WHEN f.parent IN (SELECT module FROM <fx_index> i) THEN coalesce(l.section, 'unknown')
    WHEN f.parent = 'resources' THEN coalesce(l.section, CASE WHEN contains(f.name, '__') THEN split_part(f.name, '__', 1) ELSE 'ressources' END) ELSE 'unknown' END AS section, l.section AS listed
  FROM <fx_files> f LEFT JOIN listed l ON l.name = f.name AND l.module = CASE WHEN f.parent = 'resources' THEN 'ressources' ELSE f.parent END)"""


@query("join_file_section", f"WITH {_LISTED} SELECT id, name, parent, listed AS section FROM classified")
def join_file_section(spark, folder):
    return ops.file_sections(view(spark, folder, "fx_files"), view(spark, folder, "fx_index")).select(
        "id", "name", "parent", "section"
    )


@query("classify_section", f"WITH {_LISTED} SELECT id, name, parent, section FROM classified")
def classify_section(spark, folder):
    return ops.classify(view(spark, folder, "fx_files"), view(spark, folder, "fx_index")).select(
        "id", "name", "parent", "section"
    )


@query(
    "filter_covered_resources",
    f"""WITH {_LISTED} SELECT id, name, section FROM classified WHERE parent = 'resources'
    AND section IN (SELECT split_part(lower(module), '_', 2) FROM <fx_index> i WHERE contains(module, '_'))""",
)
def filter_covered_resources(spark, folder):
    index = view(spark, folder, "fx_index")
    resources = ops.classify(view(spark, folder, "fx_files"), index).where("parent = 'resources'")
    return ops.covered(resources, ops.modules(index)).select("id", "name", "section")


@query(
    "stamp_metadata", f"WITH {_LISTED} SELECT id, name AS source, 'md' AS type, section FROM classified"
)
def stamp_metadata(spark, folder):
    files = ops.classify(view(spark, folder, "fx_files"), view(spark, folder, "fx_index"))
    return ops.stamp(files).select("id", "metadata.*")


@query(
    "union_corpora",
    """SELECT id, name, CASE WHEN parent = 'resources' THEN 'resources' ELSE 'courses' END AS corpus FROM <fx_files> f""",
)
def union_corpora(spark, folder):
    files = view(spark, folder, "fx_files").select("id", "name", "parent")
    both = ops.union_corpora(files.where("parent <> 'resources'"), files.where("parent = 'resources'"))
    return both.drop("parent")


@query(
    "chunk_threshold",
    """SELECT path, min_by(length(text), page) AS first_length, min_by(length(text), page) >= 1000 AS needs_split FROM <fx_pages> p GROUP BY path""",
)
def chunk_threshold(spark, folder):
    return ops.needs_split(view(spark, folder, "fx_pages"))


@query(
    "chunk_ids",
    """SELECT concat(replace(replace(path, '/data/courses/', ''), '.md', ''), '-', row_number() OVER (PARTITION BY path ORDER BY page) - 1) AS id, page, md5(text) AS digest
    FROM <fx_pages> p""",
)
def chunk_ids(spark, folder):
    pages = view(spark, folder, "fx_pages").withColumn("pos", F.lit(0))
    return ops.chunk_ids(pages).select("id", "page", F.md5("text").alias("digest"))


@query("chunk_recursive")
def chunk_recursive(spark, folder):
    """Every document as a file of its own, cut into chunks with ids."""
    name = F.concat(F.lit("/data/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    pages = table(spark, folder, "documents").select(name.alias("path"), F.lit(0).alias("page"), "text")
    return _chunked(spark, pages).select("id", "path", "page", "pos", "text")


def _chunked(spark, pages):
    """Chunks of pages with ids; the cut texts are stored, as numbering reads them twice."""
    return ops.listed_chunk_ids(sinks.write_snapshot(ops.chunk_lists(pages), shared_folder(spark, "cut")))


@query(
    "chunk_recursive_words",
    """WITH d AS (SELECT doc_id, 20 + doc_id % 700 AS n FROM documents),
    w AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: lpad(CAST((doc_id * 7919 + i * 104729) % 10000000000 AS VARCHAR), 10, '0')) AS words FROM d),
    c AS (SELECT *, unnest(range(0, CASE WHEN n <= 91 THEN 1 ELSE 1 + CAST(ceil((n - 91) / 72) AS BIGINT) END)) AS i FROM w)
    SELECT concat('doc', doc_id, '-', i) AS id, md5(array_to_string(CASE WHEN i = 0 THEN words[1:91] ELSE words[74 + 72 * (i - 1) : 163 + 72 * (i - 1)] END, ' ')) AS digest FROM c""",
)
def chunk_recursive_words(spark, folder):
    """Texts of words of ten digits, where the places of all cuts are plain arithmetic."""
    word = "lpad(CAST((doc_id * 7919 + i * 104729) % 10000000000 AS string), 10, '0')"
    text = F.expr(f"array_join(transform(sequence(0L, 19 + doc_id % 700), i -> {word}), ' ')")
    name = F.concat(F.lit("/data/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    pages = table(spark, folder, "documents").select(name.alias("path"), F.lit(0).alias("page"), text.alias("text"))
    return _chunked(spark, pages).select("id", F.md5("text").alias("digest"))


@query(
    "chunk_recursive_whole",
    """SELECT concat('doc', doc_id, '-0') AS id, CASE WHEN length(text) < 1000 THEN md5(text) END AS digest FROM documents""",
)
def chunk_recursive_whole(spark, folder):
    """The first chunk of every file, with its digest where the file stays whole."""
    full = chunk_recursive(spark, folder)
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("/data/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        (F.length("text") < ops.CHUNK_SIZE).alias("whole"),
    )
    first = full.where(F.endswith("id", F.lit("-0"))).join(docs, "path")
    return first.select("id", F.when(F.col("whole"), F.md5("text")).alias("digest"))


@query(
    "agg_module_stats",
    f"""WITH s AS (SELECT module, section, section_pos, count(*) AS n FROM <fx_index> i GROUP BY ALL),
    m AS (SELECT module, count(*) AS sections_count, CAST(sum(n) AS BIGINT) AS files_count, list(section ORDER BY section_pos)[1:3] AS first FROM s GROUP BY module)
    SELECT module AS id, {_title_sql('module')} AS name,
      concat(array_to_string(list_transform(first, lambda s: {_title_sql('s')}), ', '), CASE WHEN sections_count > 3 THEN concat(' and ', sections_count - 3, ' other sections') ELSE '' END) AS description,
      sections_count, files_count FROM m""",
)
def agg_module_stats(spark, folder):
    return ops.module_stats(view(spark, folder, "fx_index"))


@query(
    "union_general_module",
    f"""SELECT 'general' AS id, 'General' AS name, 0 AS files_count, 0 AS place UNION ALL
    SELECT module, {_title_sql('module')}, count(file), 1 FROM <fx_index> i GROUP BY module""",
)
def union_general_module(spark, folder):
    return ops.with_general(ops.module_stats(view(spark, folder, "fx_index"))).select(
        "id", "name", "files_count", "place"
    )


@query(
    "fn_module_display_name",
    f"""WITH k AS (SELECT DISTINCT p_brand AS raw, lower(split_part(p_name, ' ', 2)) AS word, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' ELSE concat('c++', p_size, lower(p_type), '_x') END AS module FROM part)
    SELECT DISTINCT module, CASE module WHEN 'python' THEN 'Python - Complete' WHEN 'sql' THEN 'SQL - Databases' ELSE {_title_sql('module')} END AS name FROM k""",
)
def fn_module_display_name(spark, folder):
    key = F.expr(
        "CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' ELSE concat('c++', p_size, lower(p_type), '_x') END"
    )
    keys = table(spark, folder, "part").select(key.alias("module")).distinct()
    return keys.withColumn("name", txt.module_display_name(F.col("module")))


@query(
    "fn_module_description",
    f"""WITH s AS (SELECT DISTINCT p_brand, concat('0', p_size % 5, '_', lower(p_type), '_part') AS section FROM part),
    m AS (SELECT p_brand, count(*) AS n, list(section ORDER BY section)[1:3] AS first FROM s GROUP BY p_brand)
    SELECT p_brand AS module, concat(array_to_string(list_transform(first, lambda s: {_title_sql('s')}), ', '), CASE WHEN n > 3 THEN concat(' and ', n - 3, ' other sections') ELSE '' END) AS description FROM m""",
)
def fn_module_description(spark, folder):
    section = F.expr("concat('0', p_size % 5, '_', lower(p_type), '_part')")
    sections = table(spark, folder, "part").select("p_brand", section.alias("section")).distinct()
    grouped = sections.groupBy(F.col("p_brand").alias("module")).agg(
        F.sort_array(F.collect_list("section")).alias("all"), F.count("*").alias("n")
    )
    return grouped.select("module", txt.module_description(F.slice("all", 1, 3), F.col("n")).alias("description"))


_MODULE_NAME = f"""WITH m AS (SELECT DISTINCT CASE WHEN starts_with(module, '01_') THEN substr(module, 4) ELSE module END AS id, concat('Name of ', module) AS name FROM <fx_index> i)
    SELECT c.id, c.module, coalesce(m.name, {_title_sql('c.module')}) AS module_name FROM <fx_courses> c LEFT JOIN m ON m.id = c.module"""


@query("join_module_name", _MODULE_NAME)
@query("join_module_name_whole", _MODULE_NAME)
def join_module_name(spark, folder):
    """Every module by its whole name, of any length."""
    names = ops.modules(view(spark, folder, "fx_index")).select(
        F.regexp_replace("module", r"\A01_", "").alias("id"), F.concat(F.lit("Name of "), F.col("module")).alias("name")
    )
    return ops.with_module_name(view(spark, folder, "fx_courses"), names).select("id", "module", "module_name")


@query(
    "list_sections",
    f"""SELECT module, section, section_pos, count(file) AS files_count, {_title_sql('section')} AS name FROM <fx_index> i GROUP BY module, section, section_pos""",
)
def list_sections(spark, folder):
    return ops.sections(view(spark, folder, "fx_index"))


_SEARCH = """
WITH q AS (SELECT doc_id AS query_id, CASE WHEN source = 'src0' THEN 'ressources' ELSE concat('01_', source) END AS module,
  CASE doc_id % 3 WHEN 0 THEN concat('INTRO_to_', lang) WHEN 1 THEN concat('DOC', doc_id) ELSE lang END AS query FROM documents),
s AS (SELECT DISTINCT module, section, section_pos FROM <fx_index> i),
hits AS (
  SELECT q.query_id, q.module, 'section' AS type, s.section, NULL AS file, CASE WHEN lower(s.section) = lower(q.query) THEN 'high' ELSE 'medium' END AS relevance, section_pos, -1 AS file_pos
  FROM q JOIN s ON s.module = q.module AND contains(lower(s.section), lower(q.query))
  UNION ALL
  SELECT q.query_id, q.module, 'file', i.section, i.file, 'high', section_pos, file_pos FROM q JOIN <fx_index> i ON i.module = q.module AND contains(lower(i.file), lower(q.query)))"""


def _searched(spark, folder):
    docs = table(spark, folder, "documents")
    queries = docs.selectExpr(
        "doc_id AS query_id",
        "CASE WHEN source = 'src0' THEN 'ressources' ELSE concat('01_', source) END AS module",
        "CASE doc_id % 3 WHEN 0 THEN concat('INTRO_to_', lang) WHEN 1 THEN concat('DOC', doc_id) ELSE lang END AS query",
    )
    index = view(spark, folder, "fx_index")
    postings = sinks.write_snapshot(ops.name_postings(index, queries), shared_folder(spark, "postings"))
    return ops.search_index(index, queries, postings)


@query("index_search", f"{_SEARCH} SELECT query_id, module, type, section, file, relevance FROM hits")
def index_search(spark, folder):
    return _searched(spark, folder).drop("section_pos", "file_pos")


@query(
    "sort_search_relevance",
    f"""{_SEARCH} SELECT query_id, type, section, file, row_number() OVER (PARTITION BY query_id ORDER BY CASE relevance WHEN 'high' THEN 0 ELSE 1 END, section_pos, file_pos) AS position FROM hits""",
)
def sort_search_relevance(spark, folder):
    return ops.by_relevance(_searched(spark, folder)).select("query_id", "type", "section", "file", "position")


@query(
    "sink_chunk_upsert",
    """WITH incoming AS (SELECT concat('doc', doc_id % 300, '-0') AS id, concat('/', source, '/', doc_id) AS path, 0 AS pos, lang AS section FROM documents),
    stored AS (SELECT concat('doc', item_id, '-0') AS id, 'stored' AS section FROM benchmark),
    first AS (SELECT id, arg_min(section, path) AS section FROM incoming GROUP BY id)
    SELECT id, section FROM stored UNION ALL SELECT id, section FROM first WHERE id NOT IN (SELECT id FROM stored)""",
)
def sink_chunk_upsert(spark, folder):
    """Documents whose ids collide, added to a stored collection."""
    number = F.concat(F.lit("doc"), (F.col("doc_id") % 300).cast("string"), F.lit("-0"))
    incoming = table(spark, folder, "documents").select(
        number.alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.lit(0).alias("pos"),
        F.col("lang").alias("section"),
    )
    stored = table(spark, folder, "benchmark").select(
        F.concat(F.lit("doc"), F.col("item_id").cast("string"), F.lit("-0")).alias("id"),
        F.lit("stored").alias("path"),
        F.lit(0).alias("pos"),
        F.lit("stored").alias("section"),
    )
    merged = sinks.merge_chunks(stored, incoming)
    return sinks.write_snapshot(merged, shared_folder(spark, "chunks")).select("id", "section")


def _questions(spark, folder):
    """One question per label: the mean of its vectors."""
    parts = view(spark, folder, "fx_vectors").select("label", F.posexplode("vector").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vector")
    )


_KNN = """WITH parts AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos),
questions AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS point FROM means GROUP BY label),
pairs AS (SELECT q.query_id, e.vec_id AS id, list_sum(list_transform(range(1, len(point) + 1), lambda i: (point[i] - CAST(embedding[i] AS DOUBLE)) * (point[i] - CAST(embedding[i] AS DOUBLE)))) AS distance
  FROM questions q CROSS JOIN embeddings e),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs) t WHERE rank <= 5)"""


@query("knn_topk", f"{_KNN} SELECT query_id, id, rank, round(distance, 6) AS distance FROM hits")
def knn_topk(spark, folder):
    hits = retrieval.knn(_questions(spark, folder), view(spark, folder, "fx_vectors"))
    return hits.withColumn("distance", F.round("distance", 6))


@query("knn_index")
def knn_index(spark, folder):
    """The same questions through an inverted file; its recall is measured in the tests."""
    vectors = view(spark, folder, "fx_vectors")
    cells = retrieval.fit_cells(vectors)
    return retrieval.knn_probed(_questions(spark, folder), retrieval.assign_cells(vectors, cells), cells)


@query(
    "knn_every_vector",
    """SELECT query_id, rank, id FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
      list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE)))), e.vec_id) AS rank
      FROM embeddings q CROSS JOIN embeddings e) t WHERE rank <= 2""",
)
def knn_every_vector(spark, folder):
    """As many questions as chunks: each vector asks for its nearest two."""
    vectors = view(spark, folder, "fx_vectors")
    return retrieval.knn(vectors.select(F.col("id").alias("query_id"), "vector"), vectors, 2).select("query_id", "rank", "id")


@query(
    "topk_knn", f"{_KNN} SELECT h.query_id, h.rank, e.label FROM hits h JOIN embeddings e ON e.vec_id = h.id"
)
def topk_knn(spark, folder):
    vectors = view(spark, folder, "fx_vectors")
    return retrieval.knn(_questions(spark, folder), vectors).join(vectors, "id").select("query_id", "rank", "label")


def _contexts(spark, folder):
    vectors = view(spark, folder, "fx_vectors")
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source")
    )
    return retrieval.context(retrieval.knn(_questions(spark, folder), vectors), docs)


_CONTEXT = f"""{_KNN}, contexts AS (SELECT h.query_id, string_agg(d.text, concat(chr(10), chr(10)) ORDER BY h.rank) AS context,
  string_agg(CASE WHEN d.doc_id % 4 <> 0 THEN d.source ELSE 'Unknown' END, ',' ORDER BY h.rank) AS sources
  FROM hits h JOIN documents d ON d.doc_id = h.id GROUP BY h.query_id)"""


@query("rag_context", f"{_CONTEXT} SELECT query_id, context, sources FROM contexts")
def rag_context(spark, folder):
    return _contexts(spark, folder).withColumn("sources", F.array_join("sources", ","))


@query(
    "assemble_prompts",
    """SELECT conv_id, turn, concat('Topic: ', text, ' (dans le contexte de ', role, ')', chr(10), 'Ask ', turn, ' {questions} in ', role, '.') AS prompt FROM conversations""",
)
def assemble_prompts(spark, folder):
    template = "Topic: {topic}\nAsk {num_questions} {{questions}} in {language}."
    filled = retrieval.prompt(
        template,
        topic=retrieval.topic_in_module(F.col("text"), F.col("role")),
        num_questions=F.col("turn"),
        language=F.col("role"),
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", filled.alias("prompt"))


@query(
    "assemble_rag_prompts",
    f"""{_CONTEXT} SELECT query_id, md5(concat('Context:', chr(10), context, chr(10), 'Question: label ', query_id)) AS digest FROM contexts""",
)
def assemble_rag_prompts(spark, folder):
    question = F.concat(F.lit("label "), F.col("query_id").cast("string"))
    filled = retrieval.prompt("Context:\n{context}\nQuestion: {question}", context=F.col("context"), question=question)
    return _contexts(spark, folder).select("query_id", F.md5(filled).alias("digest"))


@query(
    "project_session_topic",
    "SELECT conv_id, turn, substring(text, 1, 100) AS topic FROM conversations WHERE role = 'user'",
)
def project_session_topic(spark, folder):
    asked = table(spark, folder, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", txt.session_topic(F.col("text")).alias("topic"))

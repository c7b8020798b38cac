"""Segmentation, headings, screenplays, front matter, chunks."""

from pyspark.sql import functions as F

from riskframe.catalog.inputs import (
    PAGES_TEXT, PARAGRAPHS, SCRIPTS_TEXT, WS_SQL, documents, ltrim_sql, pages_text, scripts_text, strip_sql, xml_scripts,
)
from riskframe.catalog.registry import query
from riskframe.functions.headings import parse_heading, strip_scene_number
from riskframe.functions.scoring import parse_confidence, parse_method
from riskframe.limits import CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP, CHUNK_TARGET
from riskframe.operators import chunking, screenplay, segment
from riskframe.sources.pages import assemble_pages
from riskframe.vocabulary import LOCATION_PREFIXES, TIME_WORDS

_MARKER = segment.marker_pattern()
BLOCKS = f"""{SCRIPTS_TEXT},
pieces AS (
  SELECT script_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i, len(l) AS n
  FROM (SELECT script_id, string_split(regexp_replace(replace(full_text, chr(1), ''), '(?im){_MARKER}', chr(1) || '\\1', 'g'), chr(1)) AS l
        FROM scripts_text)),
blocks AS (
  SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY i) - 1 AS INTEGER) AS block_index,
    {strip_sql('piece')} AS text,
    CASE WHEN i = 1 THEN '' ELSE {strip_sql(f"split_part({strip_sql('piece')}, chr(10), 1)")} END AS heading_line,
    i = 1 AS is_preamble,
    CAST(CASE WHEN i > 1 THEN row_number() OVER (PARTITION BY script_id, i = 1 ORDER BY i) END AS INTEGER) AS scene_number
  FROM pieces WHERE {strip_sql('piece')} <> '')"""


@query("c6_scene_blocks", f"WITH {BLOCKS} SELECT * FROM blocks")
def scene_blocks(spark, folder):
    return segment.split_scenes(scripts_text(spark, folder))


@query(
    "e6_split_summary",
    f"""WITH {BLOCKS}
SELECT script_id, count(*) AS block_count, count(*) FILTER (NOT is_preamble) AS scene_count, bool_or(is_preamble) AS has_preamble,
  bool_or(NOT is_preamble AND heading_line LIKE 'PAGE %') AS used_page_fallback FROM blocks GROUP BY script_id""",
)
def split_summary(spark, folder):
    return segment.split_summary(scene_blocks(spark, folder))


_ASSEMBLED = f"""{PAGES_TEXT},
kept AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY page_no) AS label FROM pages_text
         WHERE page_no <= 10 AND length({strip_sql('text')}) >= 10),
assembled AS (
  SELECT p.script_id, count(*) AS total_pages,
    coalesce(string_agg(CASE WHEN page_no <= 10 AND length({strip_sql('text')}) >= 10 THEN text END, chr(10) ORDER BY page_no), '') AS full_text,
    coalesce(string_agg(CASE WHEN page_no <= 10 AND length({strip_sql('text')}) < 10 THEN CAST(page_no AS VARCHAR) END, ',' ORDER BY page_no), '') AS ocr_pages,
    count(*) FILTER (page_no <= 10 AND length({strip_sql('text')}) >= 10) AS n_kept
  FROM pages_text p GROUP BY p.script_id)"""


@query(
    "a3_assembled_pages",
    f"""WITH {PAGES_TEXT},
assembled AS (
  SELECT script_id, count(*) AS total_pages,
    coalesce(string_agg(CASE WHEN length({strip_sql('text')}) >= 10 THEN text END, chr(10) ORDER BY page_no), '') AS full_text,
    coalesce(string_agg(CASE WHEN length({strip_sql('text')}) < 10 THEN CAST(page_no AS VARCHAR) END, ',' ORDER BY page_no), '') AS ocr_pages,
    count(*) FILTER (length({strip_sql('text')}) >= 10) AS n_kept
  FROM pages_text GROUP BY script_id)
SELECT script_id, total_pages, full_text, ocr_pages,
  array_to_string(list_filter([
    CASE WHEN n_kept > 0 AND length({strip_sql('full_text')}) < 50 THEN 'very little text, results may be incomplete' END,
    CASE WHEN ocr_pages <> '' THEN 'pages without text: ' || ocr_pages END], lambda w: w IS NOT NULL), ' | ') AS warnings,
  {strip_sql('full_text')} <> '' AS has_text
FROM assembled""",
)
def assembled_pages(spark, folder):
    """All pages of every script."""
    return _assembled_pages(spark, folder, None)


@query(
    "a3_assembled_pages_capped",
    f"""WITH {_ASSEMBLED}
SELECT script_id, total_pages, full_text, ocr_pages,
  array_to_string(list_filter([
    CASE WHEN total_pages > 10 THEN CAST(total_pages AS VARCHAR) || ' pages given, the first 10 were used' END,
    CASE WHEN n_kept > 0 AND length({strip_sql('full_text')}) < 50 THEN 'very little text, results may be incomplete' END,
    CASE WHEN ocr_pages <> '' THEN 'pages without text: ' || ocr_pages END], lambda w: w IS NOT NULL), ' | ') AS warnings,
  {strip_sql('full_text')} <> '' AS has_text
FROM assembled""",
)
def assembled_pages_capped(spark, folder):
    """The page cap is the feature here: 10 pages, the count still over all."""
    return _assembled_pages(spark, folder, 10)


def _assembled_pages(spark, folder, max_pages):
    return assemble_pages(pages_text(spark, folder), max_pages=max_pages).select(
        "script_id",
        "total_pages",
        "full_text",
        F.array_join(F.transform("ocr_pages", lambda n: n.cast("string")), ",").alias("ocr_pages"),
        F.array_join("warnings", " | ").alias("warnings"),
        "has_text",
    )


@query(
    "c7_page_blocks",
    f"""WITH {PAGES_TEXT},
kept AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY page_no) AS label,
           count(*) OVER (PARTITION BY script_id) AS n_kept
         FROM pages_text WHERE length({strip_sql('text')}) >= 10),
whole AS (SELECT script_id, string_agg(text, chr(10) ORDER BY page_no) AS full_text, max(n_kept) AS n_kept,
            regexp_matches(replace(string_agg(text, chr(10) ORDER BY page_no), chr(1), ''), '(?im){_MARKER}') AS marked
          FROM kept GROUP BY script_id),
rows_ AS (
  SELECT k.script_id, k.label, {strip_sql('text')} AS text, CASE WHEN label = 1 THEN '' ELSE 'PAGE ' || CAST(label AS VARCHAR) END AS heading_line,
    label = 1 AS is_preamble
  FROM kept k JOIN whole w USING (script_id) WHERE w.n_kept > 1 AND NOT marked
  UNION ALL
  SELECT script_id, 1, {strip_sql('full_text')}, '', true FROM whole WHERE n_kept = 1 AND NOT marked)
SELECT script_id, CAST(row_number() OVER (PARTITION BY script_id ORDER BY label) - 1 AS INTEGER) AS block_index, text, heading_line,
  is_preamble, CAST(CASE WHEN NOT is_preamble THEN row_number() OVER (PARTITION BY script_id, is_preamble ORDER BY label) END AS INTEGER) AS scene_number
FROM rows_ WHERE text <> ''""",
)
def page_blocks(spark, folder):
    assembled = assemble_pages(pages_text(spark, folder), max_pages=None)
    return segment.split_scenes(assembled.select("script_id", "full_text", "pages"), pages="pages")


def _heading_sql(h: str, source: str) -> str:
    """Columns of C8 for the heading expression ``h`` of relation ``source``."""
    kind = " ".join(f"WHEN starts_with(upper(t), '{p}') THEN '{v}'" for p, v in LOCATION_PREFIXES)
    cut = " ".join(f"WHEN starts_with(upper(t), '{p}') THEN {strip_sql(f'substr(t, {len(p) + 1})')}" for p, _ in LOCATION_PREFIXES)
    times = " ".join(f"WHEN '{w}' THEN '{v}'" for w, v in TIME_WORDS.items())
    return f"""h0 AS (SELECT *, {strip_sql(h)} AS t FROM {source}),
h1 AS (SELECT *, CASE {kind} ELSE 'UNKNOWN' END AS location_type, CASE {cut} ELSE t END AS rest FROM h0),
h2 AS (SELECT *, regexp_split_to_array(rest, '[{WS_SQL}]*[-–—][{WS_SQL}]*') AS parts FROM h1),
h3 AS (SELECT *, trim({strip_sql('''CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], ' - ') ELSE rest END''')}, '. ') AS place,
         CASE WHEN len(parts) > 1 THEN CASE upper({strip_sql('parts[-1]')}) {times} ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS time_of_day FROM h2),
headings AS (SELECT *, CASE WHEN place = '' THEN t ELSE place END AS location FROM h3)"""


_NUMBER = rf"^[{WS_SQL}]*\p{{Nd}}+[A-Za-z]?[{WS_SQL}]+"


@query(
    "c8_scene_headings",
    f"""WITH {BLOCKS}, scenes AS (SELECT * FROM blocks WHERE NOT is_preamble),
{_heading_sql(f"regexp_replace(heading_line, '{_NUMBER}', '')", 'scenes')}
SELECT script_id, scene_number, heading_line, location_type, location, time_of_day,
  CASE WHEN location <> 'UNKNOWN' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS parse_confidence, 'pdf_llm' AS parse_method FROM headings""",
)
def scene_headings(spark, folder):
    scenes = scene_blocks(spark, folder).where("NOT is_preamble")
    fallback = segment.is_page_fallback(F.col("is_preamble"), F.col("heading_line"))
    return (
        scenes.withColumn("h", parse_heading(strip_scene_number(F.col("heading_line"))))
        .select("script_id", "scene_number", "heading_line", "h.*", fallback.alias("_f"))
        .withColumn("parse_confidence", parse_confidence(F.col("location"), F.col("_f"), F.lit(False)))
        .withColumn("parse_method", parse_method(F.col("_f")))
        .drop("_f")
    )


_ATTRIBUTED = f"""{PARAGRAPHS},
grouped AS (SELECT *, CAST(sum(CAST(type = 'Scene Heading' AS INTEGER)) OVER (PARTITION BY script_id ORDER BY pos) AS INTEGER) AS scene_ix FROM paragraphs),
inside AS (SELECT *, type <> 'Scene Heading' AND text <> '' AS filled FROM grouped WHERE scene_ix > 0),
spoken AS (
  SELECT *, nullif(last_value(CASE WHEN filled AND type = 'Character' THEN text
      WHEN filled AND type IN ('Action', 'General', 'Transition', 'Shot') THEN '' END IGNORE NULLS)
      OVER (PARTITION BY script_id, scene_ix ORDER BY pos), '') AS who FROM inside),
emitted_ AS (SELECT *, filled AND type = 'Dialogue' AND who IS NOT NULL AS emitted FROM spoken),
marks AS (
  SELECT *, max(CASE WHEN filled AND type = 'Parenthetical' THEN pos END) OVER w AS p_pos,
    last_value(CASE WHEN filled AND type = 'Parenthetical' THEN trim(text, '() ') END IGNORE NULLS) OVER w AS p_text,
    max(CASE WHEN emitted OR (filled AND type = 'Character') THEN pos END)
      OVER (PARTITION BY script_id, scene_ix ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reset
  FROM emitted_ WINDOW w AS (PARTITION BY script_id, scene_ix ORDER BY pos)),
attributed AS (
  SELECT script_id, pos, type, number, text, scene_ix, CASE WHEN emitted THEN who END AS speaker, emitted, filled,
    CASE WHEN emitted AND p_pos > coalesce(reset, -1) THEN p_text END AS parenthetical FROM marks)"""


def _paragraphs(spark, folder):
    return screenplay.paragraphs(screenplay.xml_gate(xml_scripts(spark, folder)))


@query("c1_paragraphs", f"WITH {PARAGRAPHS} SELECT * FROM paragraphs")
def paragraphs(spark, folder):
    return _paragraphs(spark, folder)


@query("c3_title_and_count", f"""WITH {PARAGRAPHS}
SELECT script_id, 'Title ' || CAST(script_id AS VARCHAR) AS title, CAST(count(*) AS INTEGER) AS paragraph_count
FROM paragraphs GROUP BY script_id""")
def title_and_count(spark, folder):
    gated = screenplay.xml_gate(xml_scripts(spark, folder))
    return gated.select(
        "script_id", screenplay.title(F.col("doc")).alias("title"), screenplay.paragraph_count(F.col("doc")).alias("paragraph_count")
    )


@query(
    "b9_xml_gate",
    """SELECT doc_id AS script_id, CASE doc_id % 6 WHEN 0 THEN 'entities_forbidden' WHEN 1 THEN 'wrong_root' WHEN 2 THEN 'no_content'
  WHEN 3 THEN 'malformed' END AS reason FROM documents""",
)
def xml_gate(spark, folder):
    """Every script, four of six damaged in a known way."""
    n, x = F.col("script_id") % 6, F.col("xml")
    broken = (
        F.when(n == 0, F.replace(x, F.lit("<FinalDraft>"), F.lit('<!DOCTYPE a [<!ENTITY e "ee">]><FinalDraft>')))
        .when(n == 1, F.replace(x, F.lit("FinalDraft>"), F.lit("Other>")))
        .when(n == 2, F.replace(x, F.lit("Content>"), F.lit("Body>")))
        .when(n == 3, F.replace(x, F.lit("</Content><TitlePage>"), F.lit("<TitlePage>")))
        .when(n == 4, F.replace(x, F.lit("<FinalDraft>"), F.lit("<!DOCTYPE FinalDraft><!-- <!ENTITY --><FinalDraft>")))
        .otherwise(x)
    )
    return screenplay.xml_gate(xml_scripts(spark, folder).withColumn("xml", broken)).select("script_id", "reason")


@query(
    "c5_dialogue",
    f"""WITH {_ATTRIBUTED} SELECT script_id, scene_ix, pos, speaker, parenthetical, text FROM attributed WHERE emitted""",
)
def dialogue(spark, folder):
    return (
        screenplay.attribute_dialogue(_paragraphs(spark, folder))
        .where("emitted")
        .select("script_id", "scene_ix", "pos", "speaker", "parenthetical", "text")
    )


_SCENES = f"""{_ATTRIBUTED},
scenes AS (
  SELECT script_id, scene_ix, max(CASE WHEN type = 'Scene Heading' THEN text END) AS heading,
    max(CASE WHEN type = 'Scene Heading' THEN number END) AS number,
    coalesce(string_agg(CASE WHEN filled AND type IN ('Action', 'General', 'Transition', 'Shot') THEN text END, chr(10) ORDER BY pos), '') AS action_text,
    string_agg(CASE WHEN filled OR type = 'Scene Heading' THEN text END, chr(10) ORDER BY pos) AS text,
    count(*) FILTER (emitted) AS n_dialogue
  FROM attributed GROUP BY script_id, scene_ix),
seen AS (SELECT script_id, scene_ix, text AS name, min(pos) AS first_pos FROM attributed WHERE filled AND type = 'Character' GROUP BY ALL),
cast_ AS (SELECT script_id, scene_ix, string_agg(name, ',' ORDER BY first_pos) AS characters, count(*) AS n FROM seen GROUP BY ALL)"""


@query(
    "c4_scenes",
    f"""WITH {_SCENES}
SELECT script_id, scene_ix, heading, number, coalesce(characters, '') AS characters, action_text, n_dialogue, text,
  sha256(CAST(script_id AS VARCHAR) || ':' || CAST(scene_ix AS VARCHAR)) AS scene_id
FROM scenes LEFT JOIN cast_ USING (script_id, scene_ix)""",
)
def fdx_scenes(spark, folder):
    scenes = screenplay.scenes(screenplay.attribute_dialogue(_paragraphs(spark, folder)))
    return scenes.select(
        "script_id",
        "scene_ix",
        "heading",
        "number",
        F.array_join("characters", ",").alias("characters"),
        "action_text",
        F.size("dialogue").cast("bigint").alias("n_dialogue"),
        "text",
        "scene_id",
    )


@query(
    "e4_character_index",
    f"""WITH {_SCENES}
SELECT script_id, name, string_agg(CAST(scene_ix AS VARCHAR), ',' ORDER BY scene_ix) AS scene_ixs,
  min(scene_ix) AS first_scene FROM seen GROUP BY ALL""",
)
def character_index(spark, folder):
    scenes = screenplay.scenes(screenplay.attribute_dialogue(_paragraphs(spark, folder)))
    return screenplay.character_index(scenes).select(
        "script_id",
        "name",
        F.array_join(F.transform("scene_ixs", lambda i: i.cast("string")), ",").alias("scene_ixs"),
        F.col("first_seen.scene_ix").alias("first_scene"),
    )


@query(
    "e5_script_summary",
    f"""WITH {_SCENES}
SELECT d.doc_id AS script_id, coalesce(s.n, 0) AS total_scenes, coalesce(c.n, 0) AS total_characters,
  CASE WHEN s.n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS overall_confidence
FROM documents d LEFT JOIN (SELECT script_id, count(*) AS n FROM scenes GROUP BY 1) s ON s.script_id = d.doc_id
LEFT JOIN (SELECT script_id, count(DISTINCT name) AS n FROM seen GROUP BY 1) c ON c.script_id = d.doc_id""",
)
def script_summary(spark, folder):
    scenes = screenplay.scenes(screenplay.attribute_dialogue(_paragraphs(spark, folder)))
    scripts = documents(spark, folder).select(F.col("doc_id").alias("script_id"))
    return screenplay.script_summary(scripts, scenes)


# --- front matter and chunks ------------------------------------------------------------------


def _matter(spark, folder):
    """Documents with a front-matter block, an unclosed one, or none."""
    block = F.concat(
        F.lit("---\ntitle: \"Doc "), F.col("doc_id").cast("string"), F.lit("\"\nsource: "), "source",
        F.lit("\ntags: [\"a b\", 'c', "), "lang", F.lit("]\nttl_hours: "), (F.col("doc_id") % 100).cast("string"), F.lit("\n# note\n"),
    )
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(block, F.lit("---\n"), "text"))
        .when(F.col("doc_id") % 4 == 1, F.concat(block, "text"))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("\n "), block, F.lit("---  \n"), "text"))
        .otherwise(F.col("text"))
    )
    return documents(spark, folder).select("doc_id", "lang", "source", text.alias("text"))


_MATTER = """matter AS (
  SELECT doc_id, lang, source, CASE doc_id % 4 WHEN 0 THEN block || '---' || chr(10) || text WHEN 1 THEN block || text
    WHEN 2 THEN chr(10) || ' ' || block || '---  ' || chr(10) || text ELSE text END AS text
  FROM (SELECT *, '---' || chr(10) || 'title: "Doc ' || CAST(doc_id AS VARCHAR) || '"' || chr(10) || 'source: ' || source || chr(10)
     || 'tags: ["a b", ''c'', ' || lang || ']' || chr(10) || 'ttl_hours: ' || CAST(doc_id % 100 AS VARCHAR) || chr(10) || '# note' || chr(10) AS block
   FROM documents))"""


@query(
    "c10_front_matter_stripped",
    f"""WITH {_MATTER}, t AS (SELECT doc_id, text, {ltrim_sql('text')} AS s FROM matter),
c AS (SELECT *, CASE WHEN starts_with(s, '---') THEN instr(substr(s, 4), chr(10) || '---') ELSE 0 END AS close FROM t),
r AS (SELECT *, substr(s, close + 3 + 4) AS tail FROM c)
SELECT doc_id, CASE WHEN close = 0 THEN text WHEN instr(tail, chr(10)) = 0 THEN '' ELSE substr(tail, instr(tail, chr(10)) + 1) END AS text FROM r""",
)
def front_matter_stripped(spark, folder):
    return _matter(spark, folder).select("doc_id", chunking.strip_front_matter(F.col("text")).alias("text"))


@query(
    "c10_front_matter_fields",
    """SELECT doc_id, unnest(['title', 'source', 'tags', 'ttl_hours']) AS key, unnest(['string', 'bare', 'list', 'integer']) AS kind,
  unnest(['Doc ' || CAST(doc_id AS VARCHAR), source, NULL, CAST(doc_id % 100 AS VARCHAR)]) AS value,
  unnest([NULL, NULL, 'a b|c|' || lang, NULL]) AS items FROM documents WHERE doc_id % 4 = 0""",
)
def front_matter_fields(spark, folder):
    fields = _matter(spark, folder).select("doc_id", F.explode(chunking.parse_front_matter(F.col("text"))).alias("f"))
    return fields.select("doc_id", "f.key", "f.kind", "f.value", F.array_join("f.items", "|").alias("items"))


def kb_text(spark, folder):
    """Documents with every line as a paragraph of its own."""
    return documents(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


_OUT = "STRUCT(off INTEGER, body VARCHAR)[]"
_ST = f"STRUCT(out {_OUT}, buf VARCHAR, off INTEGER)"


def _st(out: str, buf: str, off: str) -> str:
    return f"CAST({{'out': {out}, 'buf': {buf}, 'off': {off}}} AS {_ST})"


def _emit(a: str, body: str) -> str:
    return f"list_append({a}.out, CAST({{'off': {a}.off, 'body': {body}}} AS STRUCT(off INTEGER, body VARCHAR)))"


_J = "length(a.buf) + 2 + length(p.body)"
_WHOLE = "a.buf || chr(10) || chr(10) || p.body"
CHUNKS = f"""flat AS (
  SELECT doc_id, {strip_sql("regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[ ' || chr(9) || ']+', ' ', 'g')")} AS t FROM documents),
cutup AS (SELECT doc_id, regexp_split_to_array(t, '\\n[{WS_SQL}]*\\n') AS ps, regexp_extract_all(t, '\\n[{WS_SQL}]*\\n') AS gs FROM flat),
placed AS (
  SELECT doc_id, i, piece, CAST(sum(length(piece) + length(coalesce(gap, ''))) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) - length(coalesce(gap, ''))
      + length(piece) - length({ltrim_sql('piece')}) AS INTEGER) AS off
  FROM (SELECT doc_id, unnest(ps) AS piece, unnest(gs) AS gap, generate_subscripts(ps, 1) AS i FROM cutup)),
paras AS (
  SELECT doc_id, list(CAST({{'off': off, 'body': {strip_sql('piece')}}} AS STRUCT(off INTEGER, body VARCHAR)) ORDER BY i) AS l
  FROM placed WHERE {strip_sql('piece')} <> '' GROUP BY doc_id),
folded AS (
  SELECT doc_id, list_reduce(l, lambda a, p:
    CASE WHEN a.buf = '' THEN {_st('a.out', 'p.body', 'p.off')}
    WHEN {_J} <= {CHUNK_MAX} AND {_J} < {CHUNK_TARGET} THEN {_st('a.out', _WHOLE, 'a.off')}
    WHEN {_J} <= {CHUNK_MAX} THEN {_st(_emit('a', _WHOLE), f'right({_WHOLE}, {CHUNK_OVERLAP})', f'a.off + {_J} - least({_J}, {CHUNK_OVERLAP})')}
    WHEN length(a.buf) >= {CHUNK_MIN} THEN {_st(_emit('a', 'a.buf'), f"CASE WHEN {strip_sql(f'right(a.buf, {CHUNK_OVERLAP})')} <> '' THEN right(a.buf, {CHUNK_OVERLAP}) || chr(10) || chr(10) || p.body ELSE p.body END", f'p.off - length(right(a.buf, {CHUNK_OVERLAP}))')}
    ELSE list_reduce(list_transform(range(0, (length(p.body) - 1) // {CHUNK_TARGET} + 1), lambda s: substr(p.body, s * {CHUNK_TARGET} + 1, {CHUNK_TARGET})),
      lambda b, s: CASE WHEN b.buf <> '' AND length(b.buf) + length(s) + 2 <= {CHUNK_MAX} THEN {_st('b.out', 'b.buf || chr(10) || chr(10) || s', 'b.off')}
        WHEN b.buf <> '' THEN {_st(_emit('b', 'b.buf'), 's', 'p.off')} ELSE {_st('b.out', 's', 'p.off')} END, a)
    END, {_st('[]', "''", '0')}) AS z FROM paras),
all_chunks AS (
  SELECT doc_id, CASE WHEN {strip_sql('z.buf')} <> '' THEN {_emit('z', strip_sql('z.buf'))} ELSE z.out END AS l FROM folded),
chunk_rows AS (
  SELECT doc_id, CAST(n - 1 AS INTEGER) AS chunk_no, c.body AS chunk_text, c.off AS chunk_offset
  FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS n FROM all_chunks))"""


@query(
    "c11_chunks",
    f"""WITH {CHUNKS}
SELECT doc_id, chunk_no, CAST(doc_id AS VARCHAR) || ':' || CASE WHEN chunk_no < 1000 THEN lpad(CAST(chunk_no AS VARCHAR), 4, '0') ELSE CAST(chunk_no AS VARCHAR) END AS chunk_id,
  chunk_text, chunk_offset, CAST(length(chunk_text) AS INTEGER) AS length, sha256(chunk_text) AS hash FROM chunk_rows""",
)
def chunks(spark, folder):
    return chunking.chunk_documents(kb_text(spark, folder), chunker=lambda c: chunking.chunks(c, strict=False))


_ROOM = CHUNK_MAX - CHUNK_OVERLAP - 2
#: The strict form: slices of paragraphs that fit, and no last chunk that is an overlap alone.
CHUNKS_STRICT = CHUNKS.replace(
    f"""SELECT doc_id, list(CAST({{'off': off, 'body': {strip_sql('piece')}}} AS STRUCT(off INTEGER, body VARCHAR)) ORDER BY i) AS l
  FROM placed WHERE {strip_sql('piece')} <> '' GROUP BY doc_id""",
    f"""SELECT doc_id, list(CAST({{'off': off + s * {_ROOM}, 'body': substr(body, CAST(s * {_ROOM} + 1 AS INTEGER), {_ROOM})}} AS STRUCT(off INTEGER, body VARCHAR)) ORDER BY i, s) AS l
  FROM (SELECT doc_id, i, off, {strip_sql('piece')} AS body, unnest(range(0, (length({strip_sql('piece')}) - 1) // {_ROOM} + 1)) AS s FROM placed WHERE {strip_sql('piece')} <> '') GROUP BY doc_id""",
).replace(
    f"CASE WHEN {strip_sql('z.buf')} <> '' THEN",
    f"CASE WHEN {strip_sql('z.buf')} <> '' AND NOT coalesce(len(z.out) > 0 AND length({strip_sql('z.buf')}) <= {CHUNK_OVERLAP} AND suffix(z.out[-1].body, {strip_sql('z.buf')}), false) THEN",
)


@query(
    "c11_chunks_strict",
    f"""WITH {CHUNKS_STRICT}
SELECT doc_id, chunk_no, CAST(doc_id AS VARCHAR) || ':' || CASE WHEN chunk_no < 1000 THEN lpad(CAST(chunk_no AS VARCHAR), 4, '0') ELSE CAST(chunk_no AS VARCHAR) END AS chunk_id,
  chunk_text, chunk_offset, CAST(length(chunk_text) AS INTEGER) AS length, sha256(chunk_text) AS hash FROM chunk_rows""",
)
def chunks_strict(spark, folder):
    return chunking.chunk_documents(kb_text(spark, folder))


@query(
    "c12_slices",
    """SELECT doc_id, CAST(i AS INTEGER) AS slice_no, substr(text, i * 4800 + 1, 4800) AS slice
FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 4800 + 1)) AS i FROM documents)""",
)
def slices(spark, folder):
    return documents(spark, folder).select("doc_id", F.posexplode(chunking.split_long(F.col("text"))).alias("slice_no", "slice"))

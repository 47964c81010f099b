"""Queries of answers, their sources, links, records and jobs.

Each document is made into an answer whose items are its lines: every item has a number of its own, a share in per cent and a
cited paper, and the papers' blocks know every second share.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import answers as rules
from tidemill.functions import blocks, findings
from tidemill.operators import answers, grounding, keys
from tidemill.plans.registry import query
from tidemill.sources.tables import table
from tidemill.streaming import jobs


def _share(k):
    return ((F.col("doc_id") * 7 + k * 13) % 500 + 10).cast("string")


def _citation(k):
    return F.concat(F.lit("[2401.0000"), (k % 3).cast("string"), F.lit("v1]"))


def _answers(spark, sf_dir):
    """(answer, text, share, citation) of documents with a text; share and citation are those of the last item."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")

    def item(line, k):
        return F.concat((2 * k % 97 + 1).cast("string"), F.lit(". **N"), F.char(97 + k % 26), F.lit("**: "), line, F.lit(" "), _share(k), F.lit("%다. "), _citation(k))

    # a number of two digits or more would be a claim of its own; lines keep their words
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, "[0-9<>]", ""))
    body = F.array_join(F.transform(lines, item), "\n")
    text, last = F.concat(F.lit("### 서론\n"), F.col("lang"), F.lit("\n\n### 본론\n"), body, F.lit("\n\n### 결론\n1. 끝\n")), F.size(F.split("text", "\n", -1)) - 1
    return d.select(F.col("doc_id").alias("answer"), text.alias("text"), _share(last).alias("share"), _citation(last).alias("citation"))


def _sources(spark, sf_dir):
    """(answer, id, block): blocks of papers with the shares of their even items."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    n = F.size(F.split("text", "\n", -1))
    paper = d.select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(F.array(*map(F.lit, range(3)))).alias("p"))
    even = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: (k % 3 == F.col("p")) & (k % 2 == 0))
    said = F.array_join(F.transform(even, _share), " ; ")
    return paper.select(F.col("doc_id").alias("answer"), F.concat(F.lit("2401.0000"), F.col("p").cast("string")).alias("id"), F.concat(F.lit("[문서 "), (F.col("p") + 1).cast("string"), F.lit("] "), said).alias("block"))


_ITEMS = r"""l AS (SELECT doc_id, lang, regexp_replace(unnest(string_split(text, chr(10))), '[0-9<>]', '', 'g') AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, lang, k, line, '**N' || chr(97 + (k % 26)::INT) || '**: ' || line || ' ' AS said, (doc_id * 7 + k * 13) % 500 + 10 AS share, '2401.0000' || (k % 3) AS id FROM l)"""


def _assembled(item: str, numbers: str = "2 * k % 97 + 1", source: str = "i", end: str = "chr(10) || chr(10)") -> str:
    return f"SELECT doc_id AS answer, md5('### 서론' || chr(10) || any_value(lang) || chr(10) || chr(10) || '### 본론' || chr(10) || string_agg(({numbers}) || '. ' || {item}, chr(10) ORDER BY k) || {end} || '### 결론' || chr(10) || '1. 끝' || chr(10)) AS digest FROM {source} GROUP BY doc_id"


@query(f"WITH {_ITEMS} {_assembled("said || share || '%다. [' || id || 'v1]'", "k + 1")}")
def renumbered_answers(spark, sf_dir):
    rows = answers.renumbered(answers.lines(_answers(spark, sf_dir)))
    return answers.assembled(rows).select("answer", F.md5("text").alias("digest"))


@query(f"WITH {_ITEMS} {_assembled("said || share || '%다. [' || id || 'v1]'")}")
def split_answers(spark, sf_dir):
    """Split to lines and put together again, without a rule between."""
    return answers.assembled(answers.lines(_answers(spark, sf_dir))).select("answer", F.md5("text").alias("digest"))


@query(f"""WITH {_ITEMS}, known AS (SELECT doc_id, id, list(share) AS shares FROM i WHERE k % 2 = 0 GROUP BY doc_id, id),
c AS (SELECT i.*, list_contains(COALESCE(shares, []), share) AS told, regexp_replace(said, '([.!?。])\\s+', '\\1' || chr(1), 'g') AS parted FROM i LEFT JOIN known USING (doc_id, id)),
d AS (SELECT *, string_split(parted || share || '%다.', chr(1)) AS parts FROM c),
s AS (SELECT *, array_to_string(list_filter(parts, lambda p: told OR NOT contains(p, share || '%다.')), ' ') AS stays FROM d),
f AS (SELECT *, CASE WHEN told OR share BETWEEN 1900 AND 2099 OR NOT regexp_matches(regexp_replace(stays, '\\*\\*[^*\\n]*\\*\\*|\\[[^\\]\\n]*\\]|\\([^()\\n]*\\)|<[^>]+>', ' ', 'g'), '[\\pL\\pN_]') THEN said || share || '%다. [' || id || 'v1]' ELSE stays || CASE WHEN stays = '' THEN '' ELSE ' ' END || '[' || id || 'v1]' END AS item FROM s)
{_assembled("item", source="f")}""")
def grounded_answers(spark, sf_dir):
    """Answers without the sentences whose share no cited block has."""
    rows = answers.grounded(answers.lines(_answers(spark, sf_dir)), _sources(spark, sf_dir))
    return answers.assembled(rows).select("answer", F.md5("text").alias("digest"))


@query(f"""WITH {_ITEMS}, p AS (SELECT *, said || share || '%다. [' || id || 'v1]' AS full_item, regexp_replace(line || ' ', '^\\s+', '') || share || '%다. [' || id || 'v1]' AS more, min(k) OVER (PARTITION BY doc_id, id) AS own FROM i),
j AS (SELECT doc_id, lang, own AS k, string_agg(CASE WHEN k = own THEN full_item ELSE more END, ' ' ORDER BY k) AS item, max(k) AS last FROM p GROUP BY doc_id, lang, own) {_assembled("item", source="j", end="CASE WHEN max(last) < 3 THEN chr(10) || chr(10) ELSE chr(10) END")}""")
def merged_answers(spark, sf_dir):
    """Answers whose items of one paper are one item."""
    rows = answers.merged_papers(answers.lines(_answers(spark, sf_dir)))
    return answers.assembled(rows).select("answer", F.md5("text").alias("digest"))


@query()
def answer_findings(spark, sf_dir):
    """Every turn's brief of 300 characters, and the user's sentence that is nearest to the answer after it."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.select("conv_id", "turn", "text", before.alias("source"))
    near = findings.nearest_sentence(F.col("text"), findings.candidates(F.col("source")))
    return pairs.select("conv_id", "turn", F.md5(findings.brief(F.col("text"), 300)).alias("brief"), F.size(findings.findings(F.col("text"))["results"]).alias("n_results"), near["sentence"].alias("nearest"))


_B = """b AS (SELECT conv_id, turn, '[' || printf('%04d.%05d', 2401 + conv_id % 12, turn % 3) || 'v1] ' || text AS block FROM conversations WHERE text IS NOT NULL),
u AS (SELECT conv_id, string_split(block, chr(10))[1] AS head, block, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS again, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM b)"""


def _contexts(spark, sf_dir):
    """(conv_id, context): a conversation's turns as blocks of three papers in turn."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    block = F.concat(F.lit("["), F.format_string("%04d.%05d", 2401 + F.col("conv_id") % 12, F.col("turn") % 3), F.lit("v1] "), F.col("text"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("block")))), lambda x: x["block"])
    return c.groupBy("conv_id").agg(F.array_join(parts, blocks.BETWEEN).alias("context"))


@query(f"""WITH {_B}, t AS (SELECT conv_id, string_agg(regexp_replace(block, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS x FROM u WHERE again = 1 GROUP BY conv_id)
SELECT conv_id, md5(x) AS digest FROM t""")
def merged_contexts(spark, sf_dir):
    """Contexts with each paper's first block alone."""
    none = F.array().cast("array<string>")
    return _contexts(spark, sf_dir).select("conv_id", F.md5(blocks.merged(F.col("context"), none)).alias("digest"))


@query("""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS id FROM pages),
t AS (SELECT dst, count(*) AS n FROM l WHERE dst NOT IN (SELECT id FROM k) GROUP BY dst) SELECT dst, n, row_number() OVER (ORDER BY n DESC, dst) AS rank FROM t""")
def link_targets(spark, sf_dir):
    """Targets of pages' links that are no page, by the number of pages that name them."""
    return grounding.outside_targets(*_links(spark, sf_dir)).select("dst", "n", F.col("rank").cast("long").alias("rank"))


def _links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    edges = p.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("dst"))
    return edges, p.select(F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("id"))


_CITING = r"""w AS (SELECT doc_id, printf('%04d.%05d', 2401 + doc_id % 12, doc_id % 900) AS own, split_part(text, chr(10), 1) || ' arXiv:' || printf('%04d.%05d', 2401 + doc_id * 7 % 12, doc_id * 7 % 900) || 'v2, see abs/' || printf('%04d.%05d', 2301 + doc_id % 14, doc_id % 50) || ' CoRR 2413.00001' AS x FROM documents WHERE text IS NOT NULL)"""


def _cites(spark, sf_dir):
    """Documents' first lines with three citations behind them, of which one has an impossible month and some are the paper's own."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    pid = lambda a, b: F.format_string("%04d.%05d", a, b)
    n = F.col("doc_id")
    text = F.concat(F.substring_index("text", "\n", 1), F.lit(" arXiv:"), pid(2401 + n * 7 % 12, n * 7 % 900), F.lit("v2, see abs/"), pid(2301 + n % 14, n % 50), F.lit(" CoRR 2413.00001"))
    return d.select(F.concat(pid(2401 + n % 12, n % 900), F.lit("v1")).alias("paper_id"), text.alias("content"))


_EDGES = rf"""{_CITING}, e AS (SELECT DISTINCT own AS src, c AS dst FROM (SELECT own, unnest(regexp_extract_all(x, '(?i)(?:arxiv|abs/|corr)[^\d\n]{{0,25}}?(\d{{4}}\.\d{{4,5}})', 1)) AS c FROM w) WHERE substr(c, 1, 4)::INT BETWEEN 704 AND 2611 AND substr(c, 3, 2)::INT BETWEEN 1 AND 12 AND c <> own)"""


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def citation_edges(spark, sf_dir):
    return grounding.citation_edges(_cites(spark, sf_dir))


@query(f"WITH {_EDGES}, k AS (SELECT DISTINCT own AS id FROM w) SELECT (SELECT count(DISTINCT src) FROM e) AS sources, sum((dst IN (SELECT id FROM k))::INT)::BIGINT AS inside, sum((dst NOT IN (SELECT id FROM k))::INT)::BIGINT AS outside, count(DISTINCT CASE WHEN dst NOT IN (SELECT id FROM k) THEN dst END) AS targets FROM e")
def citation_totals(spark, sf_dir):
    cites = _cites(spark, sf_dir)
    return grounding.edge_totals(grounding.citation_edges(cites), cites.select(F.substring_index("paper_id", "v", 1).alias("id")))


@query("""WITH e AS (SELECT event_id, unnest([{'n': 'chroma:document', 'v': event_type}, {'n': 'chroma:rank', 'v': 'x'}, {'n': 'user', 'v': user_id::VARCHAR}, {'n': 'k', 'v': json_extract_string(props, '$.k')}, {'n': 'odd', 'v': CASE WHEN event_id % 2 = 1 THEN 'true' END}]) AS s FROM events)
SELECT event_id, max(CASE WHEN s.n = 'chroma:document' THEN s.v END) AS doc, string_agg(CASE WHEN NOT starts_with(s.n, 'chroma:') AND s.v IS NOT NULL THEN s.n || '=' || s.v END, ';' ORDER BY s.n) AS meta FROM e GROUP BY event_id""")
def records_from_entries(spark, sf_dir):
    """Events taken apart to entries of a name and a value of its own kind, and put together as records."""
    e = table(spark, sf_dir, "events")
    none = lambda kind: F.lit(None).cast(kind)
    entry = lambda name, s=None, i=None, b=None: F.struct(name.alias("name"), (none("string") if s is None else s).alias("s"), (none("long") if i is None else i).alias("i"), (none("boolean") if b is None else b).alias("b"))
    props = F.transform(F.map_entries(F.from_json("props", "map<string,long>")), lambda x: entry(x["key"], i=x["value"]))
    fixed = F.array(entry(F.lit("chroma:document"), s=F.col("event_type")), entry(F.lit("chroma:rank"), s=F.lit("x")), entry(F.lit("user"), i=F.col("user_id")), entry(F.lit("odd"), b=F.when(F.col("event_id") % 2 == 1, F.lit(True))))
    entries = e.select("event_id", F.inline(F.concat(fixed, F.coalesce(props, F.array().cast(props_kind())))))
    made = keys.records(entries, "event_id", ("s", "i", "b"))
    pairs = F.transform(F.map_entries(keys.as_texts(F.col("meta"))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return made.select("event_id", "doc", F.array_join(pairs, ";").alias("meta"))


def props_kind() -> str:
    return "array<struct<name:string,s:string,i:bigint,b:boolean>>"


_STATES = {"view": "processing", "click": "completed", "error": "failed", "purchase": "approval_pending", "signup": "delivered"}
_JOB = "j AS (SELECT user_id AS job, ts AS t, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " ELSE 'approval_sent' END AS state, event_id FROM events)"


def _jobs(e):
    """Events as those of jobs."""
    state = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv]), F.col("event_type")), F.lit("approval_sent"))
    return e.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), state.alias("state"))


@query(f"""WITH {_JOB}, w AS (SELECT *, lead(t) OVER (PARTITION BY job ORDER BY t, state) AS next FROM j), m AS (SELECT max(t) - INTERVAL 10 MINUTE AS mark FROM j)
SELECT job, t AS since, t + INTERVAL 2 HOUR AS stale_at FROM w, m WHERE state = 'processing' AND CASE WHEN next IS NULL THEN t + INTERVAL 2 HOUR < mark ELSE next > t + INTERVAL 2 HOUR END""")
def stale_jobs(spark, sf_dir):
    """Jobs that fall back after two hours of event time in processing, as a stream that runs to its source's end."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a folder or a pattern
    made = jobs.run_to_end(jobs.stale_jobs(_jobs(events), 7200), "stale")
    return made.select("job", F.col("since").cast("timestamp_ntz").alias("since"), F.col("stale_at").cast("timestamp_ntz").alias("stale_at"))


@query(f"""WITH {_JOB}, l AS (SELECT job, max(CASE WHEN state IN ('completed', 'failed', 'approval_pending', 'pending', 'processing') THEN t END) AS t, max(CASE WHEN state = 'delivered' THEN t END) AS d, max(CASE WHEN state = 'approval_sent' THEN t END) AS s FROM j GROUP BY job)
SELECT l.job, j.state, l.t AS "at" FROM l JOIN j ON j.job = l.job AND j.t = l.t WHERE j.state IN ('completed', 'failed', 'approval_pending') AND CASE WHEN j.state = 'approval_pending' THEN s IS NULL OR s < l.t ELSE d IS NULL OR d < l.t END""")
def outbound_jobs(spark, sf_dir):
    found = jobs.outbound(_jobs(table(spark, sf_dir, "events")))
    return found.select("job", "state", F.col("at").cast("timestamp_ntz").alias("at"))


@query("SELECT event_id, round(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)), 2) AS seconds FROM events")
def stage_seconds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("mark"))
    return jobs.stage_seconds(e, "user_id", "ts").select("event_id", "seconds")


@query()
def answer_rules(spark, sf_dir):
    """How many answers each rule on a whole text changes, over the made answers with a sentence of its kind put in."""
    a = _answers(spark, sf_dir)
    denied = F.regexp_replace("text", "### 서론\n", "### 서론\n제공된 문서에는 찾는 연구가 없습니다. ")
    ids = F.create_map(F.lit(1), F.lit("2401.00000v1"))
    noted = F.concat("text", F.lit(" (참고: 문서 1) 문서 1은 끝"))
    # shares with two decimals, of which the conclusion gives the last item's with one and its paper
    concluded = lambda said: F.concat(F.replace("text", F.lit("%다. ["), F.lit(".37%다. [")), F.lit("값은 "), "share", F.lit(f"{said}%다 "), "citation", F.lit(".\n"))
    made = a.select(
        (rules.contradiction_dropped(denied) == F.col("text")).alias("contradiction"), (rules.related_marked(F.concat("text", F.lit("찾을 수 없습니다."))) != F.concat("text", F.lit("찾을 수 없습니다."))).alias("related"),
        # a note goes with the white space before it
        (rules.internal_refs_cleaned(noted, ids) == F.concat(F.rtrim("text", F.lit("\n")), F.lit(" [2401.00000v1]은 끝"))).alias("refs"), (rules.conclusion_aligned(concluded(".4")) == concluded(".37")).alias("aligned"),
    )
    return made.agg(*[F.count_if(c).alias(c) for c in made.columns], F.count("*").alias("n"))

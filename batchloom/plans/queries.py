"""The registered queries of the engine, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import checkpoints, config, lifecycle, order, packing, payloads, reconcile, results, rules
from ..operators import telemetry as metrics
from ..operators.tenancy import visible
from ..functions.tokens import Tokenizers
from ..schemas import DEFAULT_TENANT, HEALTH_COMPONENTS, REMOTE_STATUSES, Limits
from ..sources import digests
from ..sources.ranges import Budgets, Reading
from ..sources.store import Merge, Store, insert, upsert
from ..storage import materialize, shared_dir
from ..streaming.ledger import Ledger
from . import fixtures

MAX_TOKENS, MAX_BYTES, MAX_RECORDS, MAX_FILES = 6000, 60_000, 50, 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return packing.measured(packing.with_model(fixtures.requests(spark, d), fixtures.models(spark)))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_measured(spark, d), MAX_TOKENS, MAX_BYTES, MAX_RECORDS, on_oversize="quarantine")


# SQL pieces: the same inputs as in fixtures.
WORDS = r"'[^ \t\n\r\x0b\f]+'"
REQUESTS = """req AS (
  SELECT '00000000-0000-0000-0000-' || lpad(doc_id::VARCHAR, 12, '0') AS request_uuid, source AS batch_uuid, lang AS model_name,
    CASE lang WHEN 'es' THEN 'embedding' WHEN 'fr' THEN NULL ELSE 'chat' END AS model_mode, coalesce(text, '') AS prompt, text, doc_id AS created
  FROM documents)"""
MEASURED = f"""{REQUESTS}, mea AS (
  SELECT *, len(regexp_extract_all(prompt, {WORDS}))::BIGINT AS tokens, strlen(line) + 1 AS bytes FROM (
    SELECT *, '{{"custom_id": "' || request_uuid || '", "method": "POST", "url": "' || CASE WHEN model_mode = 'embedding' THEN '/v1/embeddings' ELSE '/v1/chat/completions' END
      || '", "body": {{"model": ' || to_json(model_name)::VARCHAR || CASE WHEN model_mode = 'embedding' THEN ', "input": ' || coalesce(to_json(text)::VARCHAR, 'null') || '}}}}'
      ELSE ', "messages": [{{"role": "user", "content": ' || to_json(prompt)::VARCHAR || '}}]}}}}' END AS line FROM req))"""
ORDERED = f"""{MEASURED}, ord AS (
  SELECT *, row_number() OVER (PARTITION BY batch_uuid ORDER BY created, request_uuid) AS rn FROM mea WHERE tokens <= {MAX_TOKENS} AND bytes <= {MAX_BYTES})"""
PACKED = f"""{ORDERED}, pak AS (
  SELECT batch_uuid, request_uuid, model_name, rn, 0::BIGINT AS part, tokens AS t, bytes AS b, 1::BIGINT AS n, tokens, bytes FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.batch_uuid, o.request_uuid, o.model_name, o.rn, p.part + c.cut::INT, CASE WHEN c.cut THEN 0 ELSE p.t END + o.tokens, CASE WHEN c.cut THEN 0 ELSE p.b END + o.bytes,
    CASE WHEN c.cut THEN 0 ELSE p.n END + 1, o.tokens, o.bytes
  FROM pak p JOIN ord o ON o.batch_uuid = p.batch_uuid AND o.rn = p.rn + 1,
    LATERAL (SELECT o.model_name IS DISTINCT FROM p.model_name OR p.t + o.tokens > {MAX_TOKENS} OR p.b + o.bytes > {MAX_BYTES} OR p.n + 1 > {MAX_RECORDS} AS cut) c)"""
PARTS = f"""{PACKED}, prt AS (
  SELECT batch_uuid, part AS part_index, any_value(model_name) AS model_name, count(*) AS record_count, sum(tokens)::BIGINT AS total_tokens, sum(bytes)::BIGINT AS byte_size,
    CASE WHEN part < {MAX_FILES} THEN 'ready' ELSE 'overflow' END AS state FROM pak GROUP BY ALL)"""
FILE_ID = "'file_' || md5({part_of}batch_uuid || '/' || {part}::VARCHAR)"


@query(f"WITH {MEASURED} SELECT request_uuid, 0::BIGINT AS system_tokens, tokens AS user_tokens, tokens AS total_tokens FROM mea")
def token_counts_per_request(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("request_uuid", "system_tokens", "user_tokens", "total_tokens")


CHAT = f"""cht AS (
  SELECT 'c' || u.conv_id || '-t' || u.turn AS request_uuid, 'batch-' || (u.conv_id % 8) AS batch_uuid,
    CASE WHEN u.conv_id % 3 = 2 THEN 0 ELSE len(regexp_extract_all(coalesce(f.system_prompt, ''), {WORDS})) END AS s, len(regexp_extract_all(coalesce(u.text, ''), {WORDS})) AS u
  FROM conversations u LEFT JOIN (SELECT conv_id, min_by(text, turn) AS system_prompt FROM conversations WHERE role = 'assistant' GROUP BY ALL) f USING (conv_id) WHERE u.role = 'user')"""


@query(f"""WITH {CHAT} SELECT batch_uuid, sum(s + u)::BIGINT AS total_tokens, sum(s)::BIGINT AS system_tokens, sum(u)::BIGINT AS user_tokens, count(*) AS request_count,
  avg(s + u) AS avg_tokens, max(s + u)::BIGINT AS max_tokens, min(s + u)::BIGINT AS min_tokens FROM cht GROUP BY ALL""")
def token_stats_by_batch(spark: SparkSession, d: str) -> DataFrame:
    m = packing.measured(packing.with_model(fixtures.chat_requests(spark, d), fixtures.models(spark)))
    return packing.enforce_batch_limit(packing.token_stats(m), Limits().effective())


LAST_SETTINGS = """cfg AS (
  SELECT CASE event_type WHEN 'click' THEN 'batch_size.min' WHEN 'view' THEN 'optimization.auto_split' WHEN 'signup' THEN 'batch_size.max' WHEN 'purchase' THEN 'token_limits.per_batch' ELSE 'user-' || user_id END AS k,
    CASE event_type WHEN 'click' THEN floor(value)::BIGINT::VARCHAR WHEN 'view' THEN CASE WHEN value > 100 THEN 'true' ELSE 'false' END WHEN 'signup' THEN '50000' WHEN 'purchase' THEN (1000 + event_id)::VARCHAR ELSE 'v' || event_id END AS v
  FROM events QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1)"""


@query(f"""WITH {CHAT}, {LAST_SETTINGS}, lim AS (SELECT v::BIGINT * 95 // 100 AS most FROM cfg WHERE k = 'token_limits.per_batch')
SELECT batch_uuid, sum(s + u)::BIGINT AS total_tokens, most AS effective_limit, sum(s + u) > most AS is_above FROM cht, lim GROUP BY batch_uuid, most""")
def effective_limits(spark: SparkSession, d: str) -> DataFrame:
    """Batches against the token limit that is stored, less its buffer."""
    limit = config.effective_limit(config.typed(config.upserted(fixtures.config_rows(spark, d)))).first()["effective_limit"]
    stats = packing.token_stats(packing.measured(packing.with_model(fixtures.chat_requests(spark, d), fixtures.models(spark))))
    return stats.select("batch_uuid", "total_tokens", F.lit(limit).cast("long").alias("effective_limit"), (F.col("total_tokens") > limit).alias("is_above"))


@query(f"WITH {MEASURED} SELECT request_uuid, line, bytes AS byte_size FROM mea")
def render_request_lines(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("request_uuid", "line", "byte_size")


@query(f"WITH {MEASURED} SELECT request_uuid, CASE model_name WHEN 'de' THEN length(prompt) WHEN 'fr' THEN 2 * tokens ELSE tokens END::BIGINT AS total_tokens FROM mea")
def token_counts_by_model(spark: SparkSession, d: str) -> DataFrame:
    """A tokenizer by name for de, one by the model's own name for fr, whose row names none, words for the rest."""
    models = fixtures.models(spark).withColumn("tokenizer_model", F.when(F.col("model_id") == "de", "letters").otherwise(F.col("tokenizer_model")))
    known = Tokenizers()
    known.register("words", known.get("whitespace"))
    known.register("letters", lambda text: F.coalesce(F.length(text), F.lit(0)).cast("long"))
    known.register("fr", lambda text: 2 * known.get("whitespace")(text))
    m = packing.measured(packing.with_model(fixtures.requests(spark, d), models), known)
    return m.select("request_uuid", "total_tokens")


@query(f"""WITH {MEASURED}, c AS (SELECT *, row_number() OVER w AS rn, model_name IS DISTINCT FROM lag(model_name) OVER w AS changed FROM mea WINDOW w AS (PARTITION BY batch_uuid ORDER BY created, request_uuid))
SELECT request_uuid, batch_uuid, sum((changed AND rn > 1)::INT) OVER (PARTITION BY batch_uuid ORDER BY rn)::BIGINT AS run_index FROM c""")
def model_runs(spark: SparkSession, d: str) -> DataFrame:
    slim = fixtures.requests(spark, d).select("request_uuid", "batch_uuid", "model_name", "created_at")
    return packing.runs(slim).select("request_uuid", "batch_uuid", "run_index")


@query(f"WITH RECURSIVE {PARTS} SELECT * FROM prt")
def pack_parts(spark: SparkSession, d: str) -> DataFrame:
    return packing.parts(_packed(spark, d), MAX_FILES)


@query(f"WITH RECURSIVE {PACKED} SELECT batch_uuid, request_uuid, model_name, part AS part_index, n AS position, tokens AS total_tokens, bytes AS byte_size FROM pak")
def pack_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query(f"""WITH RECURSIVE {MEASURED}, o AS (SELECT *, row_number() OVER (ORDER BY created, request_uuid) AS rn FROM mea WHERE tokens <= {MAX_TOKENS} AND bytes <= {MAX_BYTES}),
p AS (SELECT request_uuid, rn, 0::BIGINT AS part, tokens AS t, bytes AS b, 1::BIGINT AS n, tokens, bytes FROM o WHERE rn = 1
  UNION ALL SELECT o.request_uuid, o.rn, p.part + c.cut::INT, CASE WHEN c.cut THEN 0 ELSE p.t END + o.tokens, CASE WHEN c.cut THEN 0 ELSE p.b END + o.bytes, CASE WHEN c.cut THEN 0 ELSE p.n END + 1, o.tokens, o.bytes
  FROM p JOIN o ON o.rn = p.rn + 1, LATERAL (SELECT p.t + o.tokens > {MAX_TOKENS} OR p.b + o.bytes > {MAX_BYTES} OR p.n + 1 > {MAX_RECORDS} AS cut) c)
SELECT 'all' AS batch_uuid, request_uuid, 'any' AS model_name, part AS part_index, n AS position, tokens AS total_tokens, bytes AS byte_size FROM p""")
def pack_single_run(spark: SparkSession, d: str) -> DataFrame:
    """All documents one batch of one model: a single run, cut in several tasks."""
    m = _measured(spark, d).withColumns({"batch_uuid": F.lit("all"), "model_name": F.lit("any")})
    return packing.pack(m, MAX_TOKENS, MAX_BYTES, MAX_RECORDS, on_oversize="quarantine")


@query(f"""WITH RECURSIVE {MEASURED}, o AS (SELECT *, row_number() OVER (PARTITION BY batch_uuid ORDER BY created, request_uuid) AS rn FROM mea WHERE tokens <= {MAX_TOKENS}),
p AS (SELECT batch_uuid, rn, 0::BIGINT AS part, tokens AS t, 1::BIGINT AS n, tokens FROM o WHERE rn = 1
  UNION ALL SELECT o.batch_uuid, o.rn, p.part + c.cut::INT, CASE WHEN c.cut THEN 0 ELSE p.t END + o.tokens, CASE WHEN c.cut THEN 0 ELSE p.n END + 1, o.tokens
  FROM p JOIN o ON o.batch_uuid = p.batch_uuid AND o.rn = p.rn + 1, LATERAL (SELECT p.t + o.tokens > {MAX_TOKENS} OR p.n + 1 > 50 AS cut) c)
SELECT batch_uuid, part AS chunk_index, count(*) AS record_count, sum(tokens)::BIGINT AS total_tokens FROM p GROUP BY ALL""")
def pack_split_internal(spark: SparkSession, d: str) -> DataFrame:
    chunks = packing.pack(_measured(spark, d), MAX_TOKENS, max_records=Limits().internal_chunk, by_model=False, on_oversize="quarantine")
    return packing.parts(chunks).select("batch_uuid", F.col("part_index").alias("chunk_index"), "record_count", "total_tokens")


@query(f"WITH RECURSIVE {PARTS} SELECT batch_uuid, sum(record_count)::BIGINT AS total_requests, sum(total_tokens)::BIGINT AS total_tokens, count_if(state = 'ready')::BIGINT AS ready_files, count_if(state = 'overflow')::BIGINT AS overflow_files FROM prt GROUP BY ALL")
def ready_overflow(spark: SparkSession, d: str) -> DataFrame:
    return packing.batch_totals(packing.parts(_packed(spark, d), MAX_FILES))


@query("""WITH %s SELECT request_uuid, tokens AS total_tokens, bytes AS byte_size, CASE WHEN tokens > 2000 THEN 'TOKEN_LIMIT_EXCEEDED' ELSE 'VALIDATION_ERROR' END AS reason FROM mea WHERE tokens > 2000 OR bytes > 12000""" % MEASURED)
def oversize_requests(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversize(_measured(spark, d), 2000, 12_000).select("request_uuid", "total_tokens", "byte_size", "reason")


@query(f"WITH RECURSIVE {PACKED} SELECT {FILE_ID.format(part_of='pak.', part='part')} AS payload_file_id, pak.request_uuid, n AS sequence_no, line AS line_text FROM pak JOIN mea USING (request_uuid)")
def jsonl_lines(spark: SparkSession, d: str) -> DataFrame:
    m = _measured(spark, d)
    return payloads.lines(m, _packed(spark, d))


@query(f"""WITH RECURSIVE {PACKED} SELECT {FILE_ID.format(part_of='pak.', part='part')} AS file_id, count(*) AS line_count, sha256(string_agg(line, chr(10) ORDER BY n) || chr(10)) AS text_sha256
FROM pak JOIN mea USING (request_uuid) GROUP BY ALL""")
def payload_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    docs = payloads.documents(jsonl_lines(spark, d))
    return docs.select("file_id", "line_count", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(f"WITH RECURSIVE {PARTS} SELECT batch_uuid, part_index, {FILE_ID.format(part_of='', part='part_index')} AS payload_file_id, 'memory://' || {FILE_ID.format(part_of='', part='part_index')} AS file_path, record_count AS request_count, total_tokens, state FROM prt")
def batch_files(spark: SparkSession, d: str) -> DataFrame:
    return payloads.batch_files(pack_parts(spark, d))


@query(f"WITH RECURSIVE {PARTS} SELECT CASE WHEN model_name = 'es' THEN 'line_count' END AS problem, count(*) AS n FROM prt GROUP BY ALL")
def payload_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Stored payloads checked; those of one model have had their line count spoilt."""
    docs = payloads.documents(jsonl_lines(spark, d))
    spoilt = docs.withColumn("line_count", F.when(F.contains("text", F.lit('"model": "es"')) & F.contains("text", F.lit("/v1/embeddings")), F.col("line_count") + 1).otherwise(F.col("line_count")))
    return payloads.integrity(spoilt).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {PACKED} SELECT r.batch_uuid, count(*) AS requests, count(pak.request_uuid) AS assigned FROM req r LEFT JOIN pak USING (request_uuid) GROUP BY ALL")
def assigned_requests(spark: SparkSession, d: str) -> DataFrame:
    m = _measured(spark, d).withColumn("batch_file_uuid", F.lit(None).cast("string"))
    out = payloads.assign(m, payloads.lines(m, _packed(spark, d)))
    return out.groupBy("batch_uuid").agg(F.count("*").alias("requests"), F.count("batch_file_uuid").alias("assigned"))


@query("SELECT d.source AS batch_uuid, count(*) AS queued FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY ALL")
def queued_requests(spark: SparkSession, d: str) -> DataFrame:
    return packing.queued(fixtures.requests(spark, d)).groupBy("batch_uuid").agg(F.count("*").alias("queued"))


@query("SELECT * FROM (VALUES ('de', 'chat', 'words'), ('en', 'chat', 'words'), ('es', 'embedding', 'words'), ('fr', NULL, NULL)) t(model_name, model_mode, tokenizer_model)")
def model_metadata_latest(spark: SparkSession, d: str) -> DataFrame:
    m = packing.with_model(fixtures.requests(spark, d), fixtures.models(spark))
    return m.select("model_name", "model_mode", "tokenizer_model").distinct()


@query("SELECT source AS batch_uuid, bool_or(l.doc_id IS NULL) AS has_unassigned FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ALL")
def unassigned_exists(spark: SparkSession, d: str) -> DataFrame:
    return packing.has_unassigned(fixtures.requests(spark, d))


OBSERVED = """obs AS (
  SELECT 'tenant-' || (user_id % 3) AS tenant_scope, 'gw-' || (user_id % 2) AS endpoint_alias, 'batch-' || user_id AS remote_batch_id, event_id + 1 AS ord,
    ((event_id * 7919) % 1000003) * 10000000000 + event_id AS arrival, 'file-' || user_id AS input_file_id,
    CASE event_type WHEN 'signup' THEN 'validating' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'finalizing' WHEN 'purchase' THEN CASE WHEN value > 200 THEN 'completed' ELSE 'in_progress' END
      ELSE CASE WHEN value > 300 THEN 'failed' ELSE 'unknown' END END AS status,
    CASE WHEN event_type = 'purchase' THEN 'out-' || event_id END AS output_file_id, CASE WHEN event_type <> 'view' THEN 100 ELSE 0 END AS total, event_type <> 'view' AS known,
    (props->>'$.k')::BIGINT AS completed, CASE WHEN value > 100 THEN 3 ELSE 0 END AS failed, CASE WHEN event_type = 'click' THEN replace(props, ' ', '') ELSE '{}' END AS meta, ts
  FROM events), cln AS (SELECT *, known AND completed + failed > total AS bad, status IN ('completed', 'failed') AS terminal FROM obs)"""
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
CURRENT = f"""{OBSERVED}, num AS (SELECT *, row_number() OVER (PARTITION BY tenant_scope, endpoint_alias, remote_batch_id ORDER BY arrival) AS rn FROM cln WHERE NOT bad),
fld AS (
  SELECT tenant_scope, endpoint_alias, remote_batch_id, rn, ord, status, output_file_id, total, known, completed, failed, meta, ts AS first_ts, ts AS last_ts, CASE WHEN terminal THEN ts END AS end_ts, terminal FROM num WHERE rn = 1
  UNION ALL
  SELECT n.tenant_scope, n.endpoint_alias, n.remote_batch_id, n.rn, CASE WHEN c.ok THEN n.ord ELSE f.ord END, CASE WHEN c.ok THEN n.status ELSE f.status END,
    CASE WHEN c.ok THEN coalesce(n.output_file_id, f.output_file_id) ELSE f.output_file_id END, CASE WHEN c.ok THEN greatest(n.total, f.total) ELSE f.total END, CASE WHEN c.ok THEN n.known OR f.known ELSE f.known END,
    CASE WHEN c.ok THEN greatest(n.completed, f.completed) ELSE f.completed END, CASE WHEN c.ok THEN greatest(n.failed, f.failed) ELSE f.failed END,
    CASE WHEN c.ok AND n.meta <> '{{}}' THEN n.meta ELSE f.meta END, f.first_ts, CASE WHEN c.ok THEN n.ts ELSE f.last_ts END, CASE WHEN c.ok THEN coalesce(f.end_ts, CASE WHEN n.terminal THEN n.ts END) ELSE f.end_ts END,
    CASE WHEN c.ok THEN n.terminal ELSE f.terminal END
  FROM fld f JOIN num n ON n.tenant_scope = f.tenant_scope AND n.endpoint_alias = f.endpoint_alias AND n.remote_batch_id = f.remote_batch_id AND n.rn = f.rn + 1,
    LATERAL (SELECT n.ord > f.ord AND (NOT (n.known OR f.known) OR greatest(n.completed, f.completed) + greatest(n.failed, f.failed) <= greatest(n.total, f.total)) AND (NOT f.terminal OR n.status = f.status) AS ok) c),
cur AS (SELECT * FROM fld QUALIFY row_number() OVER (PARTITION BY tenant_scope, endpoint_alias, remote_batch_id ORDER BY rn DESC) = 1)"""


@query(f"WITH {OBSERVED} SELECT tenant_scope, endpoint_alias, remote_batch_id, ord AS observation_order, status AS batch_status, output_file_id, total::BIGINT AS total_requests, known AS total_requests_known, completed AS completed_requests, failed::BIGINT AS failed_requests, meta AS provider_metadata, terminal AS is_terminal, CASE WHEN bad THEN 'counts' ELSE '' END AS problems FROM cln")
def lifecycle_normalized(spark: SparkSession, d: str) -> DataFrame:
    n = lifecycle.normalized(fixtures.observations(spark, d))
    return n.select("tenant_scope", "endpoint_alias", "remote_batch_id", "observation_order", "batch_status", "output_file_id", "total_requests", "total_requests_known", "completed_requests", "failed_requests", "provider_metadata", F.col("terminal_at").isNotNull().alias("is_terminal"), F.array_join("errors", ",").alias("problems"))


def _current(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.current(lifecycle.normalized(fixtures.observations(spark, d)))


def _stamp(name: str):  # noqa: ANN202
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query(f"""WITH RECURSIVE {CURRENT} SELECT tenant_scope, endpoint_alias, remote_batch_id, ord AS observation_order, status AS batch_status, output_file_id, total::BIGINT AS total_requests, known AS total_requests_known,
  completed AS completed_requests, failed::BIGINT AS failed_requests, meta AS provider_metadata, {STAMP.format('first_ts')} AS first_seen_at, {STAMP.format('last_ts')} AS last_observed_at, {STAMP.format('end_ts')} AS terminal_at FROM cur""")
def lifecycle_current(spark: SparkSession, d: str) -> DataFrame:
    names = ("tenant_scope", "endpoint_alias", "remote_batch_id", "observation_order", "batch_status", "output_file_id", "total_requests", "total_requests_known", "completed_requests", "failed_requests", "provider_metadata")
    return _current(spark, d).select(*names, *map(_stamp, ("first_seen_at", "last_observed_at", "terminal_at")))


@query(f"""WITH RECURSIVE {CURRENT} SELECT tenant_scope, status AS batch_status, count(*) AS jobs, count_if(terminal)::BIGINT AS complete, sum(CASE WHEN total = 0 THEN 0 ELSE round((completed + failed) / total * 100, 2) END) AS progress_sum
FROM cur GROUP BY ALL""")
def lifecycle_terminal_summary(spark: SparkSession, d: str) -> DataFrame:
    v = lifecycle.status_view(_current(spark, d))
    return v.groupBy("tenant_scope", "batch_status").agg(F.count("*").alias("jobs"), F.count_if("is_complete").alias("complete"), F.sum("progress_percentage").alias("progress_sum"))


@query(f"WITH RECURSIVE {CURRENT} SELECT endpoint_alias, remote_batch_id, {STAMP.format('last_ts')} AS last_observed_at FROM cur WHERE tenant_scope = 'tenant-1' ORDER BY last_ts, endpoint_alias, remote_batch_id LIMIT 25")
def reconciliation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.candidates(_current(spark, d), "tenant-1", 25).select("endpoint_alias", "remote_batch_id", _stamp("last_observed_at"))


PREFIX = """pre AS (SELECT event_id AS position, 'gw-' || (user_id % 2) AS endpoint_alias, 'batch-' || user_id AS remote_batch_id FROM events ORDER BY event_id LIMIT 400),
uni AS (SELECT min(position) AS position, endpoint_alias, remote_batch_id FROM pre GROUP BY ALL ORDER BY 1 LIMIT 10)"""


def _prefix(spark: SparkSession, d: str) -> DataFrame:
    o = fixtures.observations(spark, d).select((F.col("observation_order") - 1).alias("position"), "endpoint_alias", "remote_batch_id")
    return reconcile.unique_prefix(o, max_jobs=10)


@query(f"WITH {PREFIX} SELECT * FROM uni")
def reconciliation_unique_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _prefix(spark, d)


@query(f"""WITH RECURSIVE {CURRENT}, {PREFIX}, out AS (
  SELECT u.*, CASE WHEN c.status IS NULL THEN 'failed' WHEN NOT c.terminal THEN 'polled' WHEN c.output_file_id IS NOT NULL THEN 'retrieved' ELSE 'deferred' END AS outcome FROM uni u LEFT JOIN cur c USING (endpoint_alias, remote_batch_id))
SELECT count(*) AS processed, count_if(outcome = 'retrieved')::BIGINT AS retrieved, count_if(outcome = 'failed')::BIGINT AS failed FROM out""")
def reconciliation_report(spark: SparkSession, d: str) -> DataFrame:
    states = materialize(_current(spark, d), "states", compact=4)
    return reconcile.report(reconcile.outcomes(_prefix(spark, d), states, states.where("output_file_id IS NOT NULL")))


@query("""SELECT tenant_scope, remote_batch_id, count(*) AS claims, min(ord) AS first_claim, count(DISTINCT remote_batch_id) AS keys FROM (
  SELECT 'tenant-' || (user_id % 3) AS tenant_scope, 'batch-' || user_id AS remote_batch_id, event_id + 1 AS ord FROM events) GROUP BY ALL""")
def single_flight(spark: SparkSession, d: str) -> DataFrame:
    o = fixtures.observations(spark, d).select(F.col("observation_order").alias("claim_order"), F.col("status").alias("worker"), "tenant_scope", "endpoint_alias", "remote_batch_id")
    c = reconcile.single_flight(o)
    return c.groupBy("tenant_scope", "remote_batch_id").agg(F.count("*").alias("claims"), F.max(F.when(F.col("holds"), F.col("claim_order"))).alias("first_claim"), F.count_distinct("flight_key").alias("keys"))


FILES = f"""lin AS (
  SELECT 'conv-' || conv_id AS batch_id, CASE role WHEN 'assistant' THEN 'result' ELSE 'error' END AS file_kind, turn,
    '{{"custom_id": "c' || conv_id || '-t' || turn || '", "response": {{"body": {{"choices": [{{"message": {{"content": ' || to_json(text)::VARCHAR || '}}}}], "usage": {{"prompt_tokens": ' || turn
    || ', "completion_tokens": ' || n || ', "total_tokens": ' || (n + turn) || '}}}}}}}}' || CASE turn % 4 WHEN 1 THEN chr(13) || chr(10) WHEN 2 THEN chr(10) || chr(10) ELSE chr(10) END AS x
  FROM (SELECT *, len(regexp_extract_all(text, {WORDS})) AS n FROM conversations WHERE role IN ('assistant', 'user'))),
fil AS (SELECT batch_id, file_kind, batch_id || '.' || file_kind AS file_id, string_agg(x, '' ORDER BY turn) AS content FROM lin GROUP BY ALL),
phy AS (SELECT batch_id, file_kind, file_id, unnest(string_split(content[:-2], chr(10))) AS raw, generate_subscripts(string_split(content[:-2], chr(10)), 1) AS file_line_number FROM fil),
bat AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY file_kind DESC, file_line_number) AS batch_line_count FROM phy),
rec AS (SELECT *, rtrim(raw, chr(13)) AS record, row_number() OVER (PARTITION BY batch_id ORDER BY batch_line_count) AS record_count FROM bat WHERE trim(raw, chr(13)) <> '')"""


@query(f"WITH {FILES} SELECT batch_id, file_kind, file_id, file_line_number, batch_line_count, record_count, record, true AS is_object FROM rec")
def result_records(spark: SparkSession, d: str) -> DataFrame:
    return results.records(fixtures.result_files(spark, d)).select("batch_id", "file_kind", "file_id", "file_line_number", "batch_line_count", "record_count", "record", "is_object")


@query(f"WITH {FILES} SELECT *, json_valid(record) AS is_object FROM (SELECT batch_id, file_kind, file_id, unnest(string_split(trim(content, chr(13) || chr(10)), chr(10))) AS record, generate_subscripts(string_split(trim(content, chr(13) || chr(10)), chr(10)), 1) AS line_number FROM fil) WHERE record <> ''")
def result_records_lenient(spark: SparkSession, d: str) -> DataFrame:
    return results.lenient_records(fixtures.result_files(spark, d))


@query(f"""WITH {FILES} SELECT batch_id, record->>'$.custom_id' AS custom_id, record->>'$.response.body.choices[0].message.content' AS response_content, (record->>'$.response.body.usage.prompt_tokens')::INT AS prompt_tokens,
  (record->>'$.response.body.usage.completion_tokens')::INT AS completion_tokens, (record->>'$.response.body.usage.total_tokens')::INT AS total_tokens FROM rec WHERE file_kind = 'result'""")
def result_import(spark: SparkSession, d: str) -> DataFrame:
    return results.imported(results.records(fixtures.result_files(spark, d)))


@query(f"WITH {FILES} SELECT batch_id, count_if(file_kind = 'result')::BIGINT AS response_count, count_if(file_kind = 'error')::BIGINT AS error_count, bool_or(file_kind = 'error') AS has_errors, NOT bool_or(file_kind = 'error') AS batch_succeeded FROM rec GROUP BY ALL")
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    return results.summary(results.records(fixtures.result_files(spark, d)))


@query(f"WITH {FILES}, b AS (SELECT batch_id, 'batch_lines' AS budget, min(batch_line_count) AS at_line FROM bat WHERE batch_line_count > 6 GROUP BY ALL UNION ALL SELECT batch_id, 'batch_records', min(batch_line_count) FROM rec WHERE record_count > 5 GROUP BY ALL UNION ALL SELECT batch_id, 'line_bytes', min(batch_line_count) FROM bat WHERE strlen(raw) > 1500 GROUP BY ALL UNION ALL SELECT DISTINCT batch_id, 'file_bytes', 0 FROM fil WHERE strlen(content) > 4000) SELECT * FROM b")
def result_budgets(spark: SparkSession, d: str) -> DataFrame:
    return Reading(fixtures.stored_result_files(spark, d), Budgets(file_bytes=4000, line_bytes=1500, batch_lines=6, batch_records=5), range_bytes=700).broken()


@query(f"WITH {FILES}, off AS (SELECT batch_id, file_kind, sum(strlen(raw) + 1)::BIGINT AS bytes, count(*) AS lines FROM bat GROUP BY ALL) SELECT r.batch_id, r.file_kind, file_line_number, batch_line_count, record_count, record, bytes AS file_bytes, lines AS file_lines FROM rec r JOIN off USING (batch_id, file_kind)")
def result_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Records of stored files read in ranges of 700 bytes, beside where the reading has ended."""
    reading = Reading(fixtures.stored_result_files(spark, d), range_bytes=700)
    ends = reading.offsets().select("batch_id", "file_kind", F.col("bytes").alias("file_bytes"), F.col("lines").alias("file_lines"))
    return reading.records().join(ends, ["batch_id", "file_kind"]).select("batch_id", "file_kind", "file_line_number", "batch_line_count", "record_count", "record", "file_bytes", "file_lines")


@query(f"WITH {FILES} SELECT batch_id, file_kind, file_id, file_line_number, batch_line_count, record_count, true AS is_valid FROM rec")
def checkpoint_positions(spark: SparkSession, d: str) -> DataFrame:
    c = results.valid_checkpoint(results.checkpoints(fixtures.result_files(spark, d), "gw-0"))
    return c.select("batch_id", "file_kind", "file_id", "file_line_number", "batch_line_count", "record_count", "is_valid")


def _frame_sql(tag: str, payload: str) -> str:
    """Hex of a frame: the tag's length in 2 bytes, the tag, the payload's in 8 bytes, the payload (given as hex)."""
    return f"'{len(tag):04x}{tag.encode().hex()}' || printf('%016x', length({payload}) // 2) || {payload}"


@query(f"""WITH {FILES}, fra AS (SELECT *, CASE WHEN file_line_number = 1 THEN {_frame_sql("file_kind", "hex(encode(file_kind))")} || {_frame_sql("file_id", "hex(encode(file_id))")} ELSE '' END
    || {_frame_sql("file_line_number", "printf('%016x', file_line_number)")} || {_frame_sql("line_bytes", "hex(encode(raw))")} || {_frame_sql("newline_terminated", "'01'")} AS x FROM bat),
run AS (SELECT *, {_frame_sql("domain", f"'{results.DOMAIN.hex()}'")} || {_frame_sql("batch_id", "hex(encode(batch_id))")} || {_frame_sql("endpoint_alias", "hex(encode('gw-0'))")}
    || string_agg(x, '') OVER (PARTITION BY batch_id ORDER BY batch_line_count) AS y FROM fra)
SELECT rec.batch_id, 'gw-0' AS endpoint_alias, rec.file_kind, rec.file_id, 1::INTEGER AS schema_version, rec.file_line_number, rec.batch_line_count, record_count, sha256(unhex(y)) AS prefix_sha256 FROM rec JOIN run USING (batch_id, batch_line_count)""")
def checkpoint_prefix_sha(spark: SparkSession, d: str) -> DataFrame:
    return results.checkpoints(fixtures.result_files(spark, d), "gw-0")


@query(f"WITH {FILES} SELECT batch_id, file_kind, file_line_number, record_count FROM rec WHERE batch_id = 'conv-1' AND record_count > 1")
def resume_after(spark: SparkSession, d: str) -> DataFrame:
    found = results.checkpoints(fixtures.result_files(spark, d), "gw-0")
    first = found.where("batch_id = 'conv-1' AND record_count = 1").head()
    return results.resume_after(found, first.asDict()).select("batch_id", "file_kind", "file_line_number", "record_count")


ATTEMPTS = """att AS (SELECT 'batch-' || user_id AS batch_id, event_id AS attempt, rn, rc, CASE WHEN k % 4 IN (1, 2) AND rc > 1 THEN rc - 1 END AS erc FROM (
  SELECT *, greatest(1, rn - k % 3) AS rc FROM (SELECT *, (props->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events))),
swp AS (
  SELECT batch_id, attempt, rn, CASE WHEN erc IS NULL THEN rc END AS stored, CASE WHEN erc IS NULL THEN 'inserted' ELSE 'expected_previous_missing' END AS outcome FROM att WHERE rn = 1
  UNION ALL
  SELECT a.batch_id, a.attempt, a.rn, CASE WHEN o.outcome IN ('inserted', 'updated') THEN a.rc ELSE s.stored END, o.outcome FROM swp s JOIN att a ON a.batch_id = s.batch_id AND a.rn = s.rn + 1,
    LATERAL (SELECT CASE WHEN s.stored IS NULL THEN CASE WHEN a.erc IS NULL THEN 'inserted' ELSE 'expected_previous_missing' END WHEN s.stored = a.rc THEN 'idempotent'
      WHEN a.erc IS DISTINCT FROM s.stored THEN 'expected_previous_stale' WHEN a.rc <= s.stored THEN 'checkpoint_regression' ELSE 'updated' END AS outcome) o)"""


@query(f"WITH RECURSIVE {ATTEMPTS} SELECT batch_id, attempt, outcome, stored AS record_count FROM swp")
def checkpoint_cas_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.outcomes(fixtures.cas_attempts(spark, d)).select("batch_id", "attempt", "outcome", "record_count")


@query(f"WITH RECURSIVE {ATTEMPTS} SELECT batch_id, stored AS record_count FROM swp WHERE stored IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY rn DESC) = 1")
def checkpoint_current(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.current(fixtures.cas_attempts(spark, d)).select("batch_id", "checkpoint.record_count")


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query(f"WITH RECURSIVE {ATTEMPTS} SELECT batch_id, stored AS record_count FROM swp WHERE stored IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY rn DESC) = 1")
def checkpoint_store(spark: SparkSession, d: str) -> DataFrame:
    """Attempts saved to one stored table by three writers at once, each with the batches of a third of the users."""
    store, attempts = _store(spark), materialize(fixtures.cas_attempts(spark, d), "attempts")
    store.create("checkpoints", checkpoints.TABLE, checkpoints.KEYS, buckets=8)

    def write(k: int) -> None:
        own = attempts.where(F.pmod(F.crc32(F.col("batch_id").cast("binary")), F.lit(3)) == k)
        checkpoints.save(Store(spark, store.root), "checkpoints", own)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    return store.read("checkpoints").select("batch_id", "checkpoint.record_count")


@query("SELECT user_id, count(*) AS events, max(event_id) AS last_event, max(value) AS best, min_by(event_type, event_id) AS first_type FROM events GROUP BY ALL")
def store_merges(spark: SparkSession, d: str) -> DataFrame:
    """Two successive merges into a stored table, each with a part of the events of every user."""
    store, e = _store(spark), fixtures.table(spark, d, "events")
    store.create("users", "user_id long, events long, last_event long, best double, first_event long, first_type string", ["user_id"], buckets=8)

    def both(o: Callable[[str], Column], n: Callable[[str], Column]) -> dict[str, Column]:
        return {"events": o("events") + n("events"), "last_event": F.greatest(o("last_event"), n("last_event")), "best": F.greatest(o("best"), n("best")), "first_event": F.least(o("first_event"), n("first_event")), "first_type": F.when(n("first_event") < o("first_event"), n("first_type")).otherwise(o("first_type"))}

    for part in (F.col("event_id") % 2 == 1, F.col("event_id") % 2 == 0):
        seen = e.where(part).groupBy("user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"), F.max("value").alias("best"), F.min("event_id").alias("first_event"), F.min_by("event_type", "event_id").alias("first_type"))
        store.merge({"users": Merge(seen, upsert(["user_id"], both))})
    return store.read("users").select("user_id", "events", "last_event", "best", "first_type")


@query("SELECT 'c' || conv_id || '-t' || turn AS request_uuid, CASE WHEN role = 'assistant' THEN 'completed' ELSE 'queued' END AS request_status, CASE WHEN role = 'assistant' THEN text END AS response_content, CASE WHEN role = 'assistant' THEN turn END::INT AS prompt_tokens FROM conversations WHERE role IN ('assistant', 'user')")
def result_import_update(spark: SparkSession, d: str) -> DataFrame:
    """Results imported into stored requests; requests without one stay as they are."""
    store, c = _store(spark), fixtures.table(spark, d, "conversations").where("role IN ('assistant', 'user')")
    store.create("requests", results.REQUESTS, ["request_uuid"], buckets=8)
    waiting = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string")).alias("request_uuid"), F.lit("queued").alias("request_status"), *(F.lit(None).cast(t).alias(n) for n, t in (("response_content", "string"), ("prompt_tokens", "int"), ("completion_tokens", "int"), ("total_tokens", "int"))))
    store.merge({"requests": Merge(waiting, insert(["request_uuid"]))})
    found = results.imported(results.records(fixtures.result_files(spark, d)))
    store.merge({"requests": results.import_merge(found)})
    return store.read("requests").select("request_uuid", "request_status", "response_content", "prompt_tokens")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS observation_order FROM events")
def order_numbers(spark: SparkSession, d: str) -> DataFrame:
    """All events numbered in one order, over many tasks."""
    return order.numbered(fixtures.table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "observation_order").select("event_id", "observation_order")


@query(f"""WITH {FILES}, add AS (SELECT batch_id, 'consumer-' || c AS consumer, count(*) AS applied, max(record_count) AS progress FROM rec, (SELECT unnest([0, 1]) AS c) WHERE file_kind = 'result' AND (c = 0 OR record_count <= 2) GROUP BY ALL) SELECT * FROM add""")
def result_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Result records applied by two consumers, one of them in two micro-batches of which one comes twice."""
    store = _store(spark)
    store.create("applied", "batch_id string, consumer string, applied long", ["batch_id", "consumer"], buckets=8)
    found = materialize(results.checkpoints(fixtures.result_files(spark, d), "gw-0").where("file_kind = 'result'"), "checkpointed")

    def effect(consumer: str) -> Callable[[DataFrame], dict[str, Merge]]:
        add = upsert(["batch_id", "consumer"], lambda o, n: {"applied": o("applied") + n("applied")})
        return lambda fresh: {"applied": Merge(fresh.groupBy("batch_id").agg(F.count("*").alias("applied")).withColumn("consumer", F.lit(consumer)), add)}

    first = found.where("record_count <= 2")
    for consumer, parts in (("consumer-0", ((first, 0), (first, 0), (found, 1))), ("consumer-1", ((first, 0),))):
        ledger = Ledger(store, "tenant-0", consumer, effect(consumer), buckets=8)
        for records, epoch in parts:
            ledger(records, epoch)
    return store.read("applied").join(store.read("result_progress").select("batch_id", "consumer", "record_count"), ["batch_id", "consumer"]).select("batch_id", "consumer", "applied", F.col("record_count").alias("progress"))


@query("SELECT 'batch-' || user_id AS remote_batch_id, count(*) AS observations FROM events WHERE user_id % 3 = 2 GROUP BY ALL")
def tenant_visible(spark: SparkSession, d: str) -> DataFrame:
    return visible(fixtures.observations(spark, d), "tenant-2").groupBy("remote_batch_id").agg(F.count("*").alias("observations"))


@query("SELECT 'batch' AS remote_batch_id, 0::BIGINT AS observations WHERE false")
def tenant_unscoped_empty(spark: SparkSession, d: str) -> DataFrame:
    return visible(fixtures.observations(spark, d), None).groupBy("remote_batch_id").agg(F.count("*").alias("observations"))


@query(f"""WITH {LAST_SETTINGS}, def(k, v) AS (VALUES ('azure_limits.max_bytes_per_file', '209715200'), ('azure_limits.max_files_per_job', '500'), ('azure_limits.max_records_per_file', '100000'),
  ('batch_size.default', '50000'), ('batch_size.max', '50000'), ('batch_size.min', '100'), ('optimization.auto_split', 'true'), ('optimization.smart_batching', 'true'),
  ('token_limits.buffer_percentage', '5'), ('token_limits.per_batch', '5000000000'), ('token_limits.per_request', '128000'))
SELECT k AS config_key, CASE WHEN contains(k, '.') THEN split_part(k, '.', 1) ELSE 'global' END AS category, CASE WHEN contains(k, '.') THEN split_part(k, '.', 2) ELSE k END AS name,
  coalesce(cfg.v, def.v) AS value, cfg.k IS NOT NULL AS is_stored FROM cfg FULL JOIN def USING (k)""")
def config_typed(spark: SparkSession, d: str) -> DataFrame:
    """The last change of each setting, read by its default's type."""
    return config.typed(config.upserted(fixtures.config_rows(spark, d)))


@query("""SELECT CASE event_type WHEN 'click' THEN 'batch_size.min' WHEN 'view' THEN 'optimization.auto_split' ELSE 'own.' || event_type END AS config_key,
  CASE event_type WHEN 'click' THEN floor(value)::BIGINT::VARCHAR WHEN 'view' THEN CASE WHEN value > 100 THEN 'true' ELSE 'false' END ELSE 'v' || event_id END AS config_value
FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1""")
def config_store(spark: SparkSession, d: str) -> DataFrame:
    """Settings written twice to a stored table, in other forms than they are read back in."""
    store, e = _store(spark), fixtures.table(spark, d, "events")
    key = F.expr("CASE event_type WHEN 'click' THEN 'batch_size.min' WHEN 'view' THEN 'optimization.auto_split' ELSE 'own.' || event_type END")
    value = F.expr("CASE event_type WHEN 'click' THEN ' ' || CAST(floor(value) AS STRING) || ' ' WHEN 'view' THEN IF(value > 100, 'ON', 'No') ELSE 'v' || event_id END")
    for part in (e.where("event_id % 2 = 0"), e):
        config.put(store, config.upserted(part.select(key.alias("config_key"), value.alias("config_value"), F.col("event_id").alias("change"))))
    return store.read("com_config").drop("bucket_")


@query(f"""WITH {PREFIX}, o AS (SELECT u.*, CASE (split_part(remote_batch_id, '-', 2)::BIGINT) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'polled' WHEN 2 THEN 'retrieved' ELSE 'deferred' END AS outcome FROM uni u)
SELECT count(*) AS processed, count_if(outcome = 'retrieved')::BIGINT AS retrieved, count_if(outcome = 'failed')::BIGINT AS failed, string_agg(remote_batch_id || '=' || outcome, ',' ORDER BY position) AS outcomes FROM o""")
def reconciliation_pass(spark: SparkSession, d: str) -> DataFrame:
    """A call for each chosen job, a quarter of which fail without touching the others."""

    def call(alias: str, batch: str) -> str:
        if (kind := int(batch.rsplit("-", 1)[1]) % 4) == 0:
            raise TimeoutError(alias)
        return ("", "polled", "retrieved", "deferred")[kind]

    found = reconcile.outcome_list(reconcile.attempted(_prefix(spark, d), call))
    items = F.transform("outcomes", lambda x: F.concat(x["remote_batch_id"], F.lit("="), x["outcome"]))
    return found.select("processed", "retrieved", "failed", F.array_join(items, ",").alias("outcomes"))


@query("SELECT event_type AS config_key, max_by(value, event_id) AS config_value FROM events GROUP BY ALL")
def config_upsert(spark: SparkSession, d: str) -> DataFrame:
    changes = fixtures.table(spark, d, "events").select(F.col("event_type").alias("config_key"), F.col("value").alias("config_value"), F.col("event_id").alias("change"))
    return config.upserted(changes)


@query("SELECT 'gateway_api_key.' || c_custkey AS secret_key, c_name AS plain, c_name AS right_key, NULL::VARCHAR AS wrong_key FROM customer")
def secrets_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A secret per customer, stored plainly, and sealed, then opened with the right and with a wrong key."""
    s = fixtures.table(spark, d, "customer").select(F.concat(F.lit("gateway_api_key."), F.col("c_custkey").cast("string")).alias("secret_key"), F.col("c_name").alias("secret_value"))
    key = b"0123456789abcdef"
    sealed = materialize(config.stored_secrets(s, key), "secrets")
    opened = [config.clear_secrets(config.stored_secrets(s)), config.clear_secrets(sealed, key), config.clear_secrets(sealed, b"fedcba9876543210")]
    p, r, w = (o.withColumnRenamed("secret_value", n) for o, n in zip(opened, ("plain", "right_key", "wrong_key"), strict=True))
    return p.join(r, "secret_key").join(w, "secret_key")


@query("""WITH l AS (SELECT event_type, max_by(value, event_id) AS v FROM events GROUP BY ALL),
c AS (SELECT CASE event_type WHEN 'view' THEN 'tables' WHEN 'signup' THEN 'tokenizer' WHEN 'error' THEN 'checkpoints' ELSE 'config' END AS component, CASE event_type WHEN 'error' THEN v < 0 ELSE v >= 0 END AS ok FROM l),
h AS (SELECT n AS component, count(c.component) AS reports, count(c.component) = 1 AND bool_and(coalesce(ok, false)) AS ready FROM (VALUES ('tables'), ('tokenizer'), ('config'), ('secrets'), ('checkpoints')) r(n) LEFT JOIN c ON n = c.component GROUP BY ALL)
SELECT bool_and(ready) AS ready, string_agg(component, ',' ORDER BY component) FILTER (reports = 0) AS missing, string_agg(component, ',' ORDER BY component) FILTER (reports > 1) AS repeated,
  string_agg(component, ',' ORDER BY component) FILTER (NOT ready) AS not_ready FROM h""")
def health_report(spark: SparkSession, d: str) -> DataFrame:
    h = rules.health_report(fixtures.components(spark, d), HEALTH_COMPONENTS)
    return h.select("ready", *(F.array_join(n, ",").alias(n) for n in ("missing", "repeated", "not_ready")))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN false ELSE status IN (408, 425, 429, 502, 503, 504) AND attempt < 3 AND wait <= 30 END AS retry, least(0.5 * pow(2, attempt - 1), 30.0) AS ceiling FROM (
  SELECT event_id, [200, 408, 429, 500, 503, 404][(event_id % 6 + 1)::INT] AS status, event_id % 4 + 1 AS attempt, floor(value) AS wait FROM events)""")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    e = fixtures.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 == 4, "POST").otherwise("GET").alias("method"),
        F.element_at(F.array(*map(F.lit, (200, 408, 429, 500, 503, 404))), (F.col("event_id") % 6 + 1).cast("int")).alias("status"),
        (F.col("event_id") % 4 + 1).alias("attempt"),
        checks.retry_after_seconds(F.floor("value").cast("string"), F.current_timestamp()).alias("wait"),
    )
    return e.select("event_id", checks.should_retry(F.col("method"), F.col("status"), F.col("attempt"), F.col("wait")).alias("retry"), checks.backoff_ceiling(F.col("attempt")).alias("ceiling"))


@query(r"""SELECT page_id, regexp_full_match(regexp_extract(url, '[^/]*$'), '[A-Za-z0-9][A-Za-z0-9._:-]{0,255}') AS is_resource_id, regexp_matches(url, '^https://[^/:@?#\s\\]+(:[0-9]{1,5})?(/[^?#\s\\@]*)?$') AS is_gateway,
  regexp_full_match(p, '/[A-Za-z0-9_~-]+(/[A-Za-z0-9._~-]+){0,15}') AND length(p) <= 256 AS is_endpoint FROM (SELECT page_id, url, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS p FROM pages)""")
def id_validation(spark: SparkSession, d: str) -> DataFrame:
    p = fixtures.table(spark, d, "pages")
    path = F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1)
    return p.select("page_id", checks.is_resource_id(F.regexp_extract("url", r"([^/]*)\z", 1)).alias("is_resource_id"), checks.is_gateway_url(F.col("url")).alias("is_gateway"), checks.is_endpoint_path(path).alias("is_endpoint"))


@query("SELECT l_orderkey AS k, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT o_custkey, 0, count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def dq_duplicates(spark: SparkSession, d: str) -> DataFrame:
    t = fixtures.table
    a = rules.repeated(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).toDF("k", "line", "n")
    b = rules.repeated(t(spark, d, "orders"), ["o_custkey"]).select(F.col("o_custkey").alias("k"), F.lit(0).cast(a.schema["line"].dataType).alias("line"), "n")
    return a.unionByName(b)


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS parents FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dq_orphans(spark: SparkSession, d: str) -> DataFrame:
    t = fixtures.table
    o = rules.orphans(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders").select("o_custkey").distinct(), "o_custkey")
    return o.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("parents"))


@query(f"WITH {OBSERVED} SELECT status AS value, count(*) AS n FROM obs WHERE status = 'unknown' GROUP BY ALL")
def dq_enum_violations(spark: SparkSession, d: str) -> DataFrame:
    n = lifecycle.normalized(fixtures.observations(spark, d))
    return rules.outside(n, "batch_status", REMOTE_STATUSES)


@query(f"WITH {OBSERVED} SELECT * FROM (SELECT 'counts' AS rule, count_if(bad)::BIGINT AS n FROM cln UNION ALL SELECT 'order', 0 UNION ALL SELECT 'tenant', 0)")
def dq_violations(spark: SparkSession, d: str) -> DataFrame:
    n = rules.backfilled(lifecycle.normalized(fixtures.observations(spark, d)), DEFAULT_TENANT)
    fine = ~F.col("total_requests_known") | (F.col("completed_requests") + F.col("failed_requests") <= F.col("total_requests"))
    return rules.violations(n, {"counts": fine, "order": F.col("observation_order") > 0, "tenant": checks.is_scope(F.col("tenant_scope"))})


@query("""WITH c AS (SELECT event_type AS operation, CASE WHEN value > 200 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN value > 300 THEN 'timeout' WHEN value > 200 THEN '_OTHER' END AS error_type, floor(value * 1000)::BIGINT AS m FROM events),
b AS (SELECT *, CASE WHEN m < 8 THEN m ELSE 8 * (length(bin(m)) - 4) + (m >> (length(bin(m)) - 4)::BIGINT) END AS bucket FROM c),
h AS (SELECT operation, outcome, error_type, bucket, count(*) AS n, sum(m) AS total, min(m) AS low, max(m) AS high FROM b GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY operation, outcome, error_type ORDER BY bucket) AS reached, sum(n) OVER (PARTITION BY operation, outcome, error_type) AS calls,
  greatest(low, CASE WHEN bucket < 8 THEN bucket ELSE (bucket % 8 + 8) << (bucket // 8 - 1) END) AS v FROM h)
SELECT operation, outcome, error_type, sum(n)::BIGINT AS calls, sum(total)::BIGINT AS total_micros, min(low) AS low, max(high) AS high, min(v) FILTER (reached >= ceil(0.5 * calls)) AS p50, min(v) FILTER (reached >= ceil(0.99 * calls)) AS p99 FROM r GROUP BY ALL""")
def telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of an operation each, counted in two parts that are merged."""
    e = fixtures.table(spark, d, "events")
    calls = e.select("event_id", F.col("event_type").alias("operation"), F.when(F.col("value") > 200, "failure").otherwise("success").alias("outcome"), F.when(F.col("value") > 300, "timeout").when(F.col("value") > 200, "unheard of").alias("error_type"), F.floor(F.col("value") * 1000).alias("micros"))
    parts = (metrics.histogram(calls.where(F.col("event_id") % 2 == k)) for k in (0, 1))
    return metrics.summary(metrics.merged(*parts))


@query("SELECT conv_id, max(turn) + 1 - min(turn) AS span, count(*) AS turns FROM conversations GROUP BY ALL")
def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = payloads.numbered_lines(fixtures.table(spark, d, "conversations"), "conv_id", ["turn"])
    return n.groupBy("conv_id").agg((F.max("turn") + 1 - F.min("turn")).alias("span"), F.max("sequence_no").alias("turns"))


TREES = f"""WITH RECURSIVE {FILES}, arc AS (SELECT (split_part(batch_id, '-', 2)::BIGINT // 64)::VARCHAR AS name, string_agg(content, '' ORDER BY batch_id, file_kind) AS content FROM fil GROUP BY ALL),
two AS (SELECT 0 AS side, name, hex(encode(content)) AS h FROM arc UNION ALL SELECT 1, name, hex(encode(replace(content, 'c1-', 'c7-'))) FROM arc),
lea AS (SELECT side, name, length(h) // 2 AS length, unnest(range((length(h) + 2047) // 2048)) AS node, h FROM two),
blo AS (SELECT side, name, length, node, sha256('\\x00'::BLOB || unhex(substr(h, 2048 * node + 1, 2048))) AS digest FROM lea),
tre AS (SELECT side, name, length, (length + 1023) // 1024 AS width, node, digest FROM blo WHERE side = 0
  UNION ALL SELECT side, name, length, (width + 3) // 4, node // 4, sha256('\\x01'::BLOB || unhex(string_agg(digest, '' ORDER BY node))) FROM tre WHERE width > 1 GROUP BY side, name, length, width, node // 4)"""


@query(f"{TREES} SELECT name, length, digest AS root FROM tre WHERE width = 1")
def file_tree_roots(spark: SparkSession, d: str) -> DataFrame:
    """Tree digests of all archives of result files, over blocks of 1024 bytes."""
    files = fixtures.listed_archives(spark, fixtures.result_files(spark, d))
    return digests.roots(digests.tree(digests.blocks(files, 1024), 4), files)


@query(f"{TREES} SELECT a.name, a.node AS block FROM blo a JOIN blo b ON a.name = b.name AND a.node = b.node WHERE a.side = 0 AND b.side = 1 AND a.digest <> b.digest")
def changed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that differ between the archives and a copy in which the ids of conversation 1 were renamed."""
    files = fixtures.result_files(spark, d)
    a, b = (digests.tree(digests.blocks(fixtures.listed_archives(spark, f), 1024), 4) for f in (files, files.withColumn("content", F.replace("content", F.lit("c1-"), F.lit("c7-")))))
    return digests.differing(a, b, 4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


"""Registered queries: thin steps from the given tables to the operators and back."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.orders import read_table
from .bytebpe import decode_tokens, encode_descriptions
from .chat import rotated_dialogues
from .dac import read_token_files, write_token_files
from .lattice import lattice_links
from .merkle import description_fingerprints
from .mixing import mix
from .passages import repeated_passages
from .quality import fit_quality, score_quality
from .repair import conversation_audits, repaired_digests, repaired_turns
from .rows import description_rows, shared_path, written
from .sharding import shard_places
from .simhash import simhash_classes
from .toxicity import fit_toxicity, score_toxicity
from .trie import conversation_paths, prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(spark: SparkSession, d: str, column: str) -> DataFrame:
    return read_table(spark, d, "labels").filter(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("row_id"), F.col(column).alias("label"))


@query("op3_toxicity")
def op3_toxicity(spark, d):
    rows = description_rows(read_table(spark, d, "documents"), "lang")
    model = fit_toxicity(rows, learnable(spark, d, "toxic"))
    return score_toxicity(rows, model, 0.3).select(
        F.col("row_id").alias("doc_id"), held_out(F.col("row_id")).alias("held_out"), "score",
        "predicted", "language_threshold", "flagged")


@query("op4_quality")
def op4_quality(spark, d):
    rows = description_rows(read_table(spark, d, "documents"))
    model = fit_quality(rows, learnable(spark, d, "quality"))
    return score_quality(rows, model, 0.7).select(
        F.col("row_id").alias("doc_id"), held_out(F.col("row_id")).alias("held_out"), "score",
        "predicted")


@query("op6_simhash")
def op6_simhash(spark, d):
    return simhash_classes(description_rows(read_table(spark, d, "documents"))).withColumnRenamed(
        "row_id", "doc_id")


@query("op8_byte_bpe")
def op8_byte_bpe(spark, d):
    return byte_bpe_digests(description_rows(read_table(spark, d, "documents")))


def byte_bpe_digests(rows: DataFrame) -> DataFrame:
    """Digests of the encoded and again decoded descriptions."""
    terms = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = decode_tokens(encode_descriptions(rows, *terms).drop("description"), *terms)
    return coded.select(
        F.col("row_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_merkle")
def op7_merkle(spark, d):
    return description_fingerprints(description_rows(read_table(spark, d, "documents"))).select(
        F.col("row_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op9_token_codes")
def op9_token_codes(spark, d):
    path = shared_path(spark, "token-files")
    write_token_files(description_rows(read_table(spark, d, "documents")), path,
                      public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path).select(
        F.col("row_id").alias("doc_id"), "start", "n_tokens",
        F.crc32("token_ids").alias("ids_crc32"))


TOPICS = [("contact", "@"), ("web", "http"), ("legal", "icense"), ("table", " | ")]
MARGINS = ["source", "lang", "topic"]


def topic(text: Column) -> Column:
    """Topic of a whole text: the first of TOPICS whose mark it holds, else prose."""
    found = F.lit("prose")
    for name, mark in reversed(TOPICS):
        found = F.when(F.contains(text, F.lit(mark)), name).otherwise(found)
    return F.coalesce(found, F.lit("prose"))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long")


def mixed(documents: DataFrame) -> DataFrame:
    """Documents with topic, tokens, probability and kept by raked token weights."""
    marked = documents.withColumns({"topic": topic(F.col("text")), "tokens": words(F.col("text"))})
    return mix(marked.withColumnRenamed("doc_id", "row_id"), MARGINS).withColumnRenamed(
        "row_id", "doc_id")


def _mix_sql(sweeps: int = 10, rounds: int = 6, share: float = 0.5) -> str:
    case = "CASE " + " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" for n, m in TOPICS)
    steps = [f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  {case} ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS tokens FROM documents)""",
             """c AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d
  WHERE tokens > 0 GROUP BY ALL)"""]
    for m in MARGINS:
        steps.append(f"""t_{m} AS (SELECT {m}, r / sum(r) OVER () AS target_{m}
  FROM (SELECT {m}, pow(sum(tokens)::DOUBLE, 0.5) AS r FROM c GROUP BY {m}))""")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight FROM c "
                 + " ".join(f"JOIN t_{m} USING ({m})" for m in MARGINS) + ")")
    n = 0
    for _ in range(sweeps):
        for m in MARGINS:
            n += 1
            steps.append(f"w{n} AS MATERIALIZED (SELECT * REPLACE (weight * target_{m} / "
                         f"sum(weight) OVER (PARTITION BY {m}) AS weight) FROM w{n - 1})")
    steps.append(f"s0 AS MATERIALIZED (SELECT *, {share} * sum(tokens) OVER () / "
                 f"sum(weight) OVER () AS scale FROM w{n})")
    for i in range(rounds):
        full = "scale * weight >= tokens"
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (rest, remain) REPLACE (
  CASE WHEN rest > 0 THEN remain / rest ELSE scale END AS scale) FROM (SELECT *,
  sum(CASE WHEN {full} THEN 0.0::DOUBLE ELSE weight END) OVER () AS rest,
  {share} * sum(tokens) OVER () - sum(CASE WHEN {full} THEN tokens ELSE 0 END) OVER () AS remain
  FROM s{i}))""")
    return ("WITH " + ",\n".join(steps) + f"""
SELECT doc_id, topic, tokens, round(p, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < p AS kept
FROM (SELECT d.*, CASE WHEN d.tokens > 0 THEN least(1.0::DOUBLE,
    round(scale * weight / s.tokens, 9)) ELSE 0.0 END AS p
  FROM d LEFT JOIN s{rounds} s USING (source, lang, topic))""")


@query("op1_mixing", _mix_sql())
def op1_mixing(spark, d):
    return mixed(read_table(spark, d, "documents")).select(
        "doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


@query("op2_perspectives", """
WITH c AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS speaker,
    coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> 'system'),
  s AS (SELECT conv_id, perspective, turn, speaker, text, turn // 64 AS piece,
    CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
      ELSE '<|user|>' || speaker END || chr(10) AS head FROM c JOIN p USING (conv_id)),
  e AS (SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective,
    piece ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS stop FROM s)
SELECT conv_id, perspective, piece, count(*) AS n_turns,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn, speaker, text) AS text,
  coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ','
    ORDER BY turn, speaker, text) FILTER (speaker = perspective), '') AS loss_spans
FROM e GROUP BY ALL""")
def op2_perspectives(spark, d):
    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws(
        "-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotated_dialogues(read_table(spark, d, "conversations")).withColumn("loss_spans", spans)


@query("op10_lattice", """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
    AND list_cosine_similarity(a.v, b.v) >= 0.95),
  r AS (SELECT vec_id AS id, vec_id AS root FROM e UNION
    SELECT l.b AS id, r.root FROM r JOIN l ON l.a = r.id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id,
  c.component_id = e.vec_id AS kept
FROM e JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = e.vec_id""")
def op10_lattice(spark, d):
    points = read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    return lattice_links(points).withColumnRenamed("point_id", "vec_id")


@query("op5_passages")
def op5_passages(spark, d):
    return repeated_passages(description_rows(read_table(spark, d, "documents"))).withColumnsRenamed(
        {"row_id": "doc_id", "partner_id": "first_doc_id", "partner_start": "first_start",
         "partner_stop": "first_stop"})


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's bytes, each byte taken in by eight steps of one bit."""
    items = (f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: [('0x' || substr("
             f"hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {items}), lambda c, e: "
            "xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)")


SHARDS = [1.0] * 8


def _draw_sql(shard: int, weight: float) -> str:
    return (f"{weight}::DOUBLE / -ln((('0x' || substr(md5(key || '#{shard}'), 1, 13))::BIGINT "
            "+ 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)")


@query("op13_rendezvous", f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS t FROM documents),
  s AS (SELECT doc_id, ('0x' || substr(md5(key), 1, 15))::BIGINT AS hash, strlen(t) + 1 AS size,
    {_crc32_sql('t')} AS text_crc32, [{', '.join(_draw_sql(i, w) for i, w in enumerate(SHARDS))}] AS draws,
    {_draw_sql(len(SHARDS), 1.0)} AS more FROM d),
  p AS (SELECT *, list_position(draws, list_max(draws)) - 1 AS shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY hash, size, text_crc32) - 1 AS slot,
  CASE WHEN more > list_max(draws) THEN {len(SHARDS)} ELSE shard END AS grown_shard FROM p""")
def op13_rendezvous(spark, d):
    rows = description_rows(read_table(spark, d, "documents"))
    return shard_places(rows, SHARDS).select(
        F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        "slot", "grown_shard")


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """Paths whose first turns are those of the conversation that starts their hundred."""
    own = paths.select("conv_id", "path", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
                       .alias("h"))
    heads = paths.filter(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("base"), F.slice("path", 1, 5).alias("head"))
    none = F.slice("path", 1, 0)
    return own.join(heads, "base", "left").select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
        F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0))))
        .alias("path"))


@query("op12_prefix_trie", f"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT conv_id, list(struct_pack(role, text) ORDER BY turn NULLS FIRST, role, text) AS p FROM c GROUP BY conv_id),
  h AS (SELECT conv_id, p, {_crc32_sql('conv_id::VARCHAR')} % 6 AS h FROM o),
  r AS (SELECT h.conv_id, list_concat(coalesce(b.p[1:h.h], []), h.p[h.h + 1:]) AS p FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
  m AS (SELECT conv_id, d, md5(p[1:d]::VARCHAR) || len(p[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(p[1:d - 1]::VARCHAR) || len(p[1:d - 1]::VARCHAR) END AS parent,
    d = len(p) AS ends, CASE WHEN d > 0 THEN length(p[d].text) ELSE 0 END AS chars FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM r)),
  n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node),
  k AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n c WHERE c.parent = n.node) AS n_children FROM n LEFT JOIN n p ON p.node = n.parent),
  s AS (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN (SELECT top, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.chars) AS saved_tokens FROM s JOIN k USING (node) GROUP BY top) t ON t.top = k.node""")
def op12_prefix_trie(spark, d):
    paths = conversation_paths(read_table(spark, d, "conversations"))
    return prefix_trie(rebuilt_paths(written(paths, "paths"))).drop("node", "parent")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults set by a hash of conv_id and turn; nulls become one space."""
    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fault = (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20)
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
                        fault.cast("int").alias("fault")).filter("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(
            "text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))


_ROLES = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}


def _repair_sql() -> str:
    """Edit scripts by a fold over the rows that keeps the best (cost, audit) of each state."""
    # A state's entry is [cost, audit] as struct; inserts lead on from states at the same row.
    def least(options: list[str]) -> str:
        return f"list_min([{', '.join(options)}])"

    def entry(source: str, letter: str, cost: str) -> str:
        return f"struct_pack(c := {source}.c + {cost}, t := {source}.t || '{letter}')"

    def inserts(name: str) -> str:
        two = [f"{name}.q2", *(entry(f"{name}.q{q}", "I", "5") for q in (0, 1, 3))]
        three = [f"{name}.q3", entry(f"{name}.q2", "I", "5"),
                 *(f"struct_pack(c := {name}.q{q}.c + 10, t := {name}.q{q}.t || 'II')" for q in (0, 1))]
        return f"struct_pack(q0 := {name}.q0, q1 := {name}.q1, q2 := {least(two)}, q3 := {least(three)})"

    into = {q: [] for q in range(4)}
    for q, moves in _ROLES.items():
        into[q].append(entry(f"s.q{q}", "D", "2"))
        for role, to in moves:
            into[to].append(entry(f"s.q{q}", "K", f"(CASE WHEN r.ini = '{role}' AND NOT r.del THEN r.more ELSE 1000000 END)"))
            if role != "s":
                into[to].append(entry(f"s.q{q}", "R", "(CASE WHEN NOT r.del THEN 1 + r.more ELSE 1000000 END)"))
    step = ", ".join(f"q{q} := {least(o)}" for q, o in into.items())
    far = "struct_pack(c := 1000000::BIGINT, t := '~')"
    start = f"struct_pack(q0 := struct_pack(c := 0::BIGINT, t := ''), q1 := {far}, q2 := {far}, q3 := {far})"
    ws = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
  f AS (SELECT *, {_crc32_sql('key')} % 20 AS fault FROM k),
  d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
  o AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS prev,
    regexp_extract(text, '({ws})[\\x20\\x09-\\x0D]*$', 1) AS last FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
  r AS (SELECT *, last = '' OR again AS del, CASE WHEN last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more FROM o),
  a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (last = '') AS blank, count(*) FILTER (last <> '' AND again) AS duplicate,
    count(*) FILTER (NOT del AND more > 0) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
  e AS (SELECT conv_id, 0::BIGINT AS pos, {start} AS s FROM a UNION ALL
    SELECT x.conv_id, x.pos + 1, (SELECT struct_pack({step}) FROM (SELECT {inserts('x.s')} AS s)) FROM e x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.pos = x.pos + 1),
  z AS (SELECT a.*, (SELECT list_min([s.q0, s.q3]) FROM (SELECT {inserts('e.s')} AS s)) AS b FROM a JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.pos = a.n),
  l AS (SELECT conv_id, b.t AS t, unnest(range(1, length(b.t) + 1)) AS i FROM z),
  g AS (SELECT conv_id, i, t[i] AS edit, i - (length(t[1:i]) - length(replace(t[1:i], 'I', ''))) AS pos,
    length(replace(t[1:i - 1], 'D', '')) AS place FROM l),
  h AS (SELECT g.conv_id, place, edit, r.role, r.text, first_value(edit = 'K' AND r.ini = 's') OVER (PARTITION BY g.conv_id ORDER BY place) AS sys FROM g LEFT JOIN r ON g.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.pos = g.pos WHERE edit <> 'D'),
  t AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS hash FROM h GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost,
  coalesce(b.t, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op11_repair", _repair_sql())
def op11_repair(spark, d):
    turns = read_table(spark, d, "conversations")
    rows = damaged(turns)
    audits = written(conversation_audits(rows), "audits")
    digests = repaired_digests(repaired_turns(rows, audits))
    found = audits.join(digests.withColumnRenamed("conv_id", "hashed"),
                        F.col("conv_id").eqNullSafe(F.col("hashed")), "left")
    every = turns.select(F.col("conv_id").alias("original")).distinct()
    joined = every.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("original").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

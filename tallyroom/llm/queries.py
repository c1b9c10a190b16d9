"""The queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import (
    chat, decontamination, jaccard, langid, maxscore, pieces, pii, secretscan, substrings, tokenfiles, toxicity, turnrepair, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxicity(documents, labels, learn_from=fold(4) != 2)
    return scored.select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending",
    )


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = langid.language(table(spark, sf_dir, "documents"), learn_from=fold(5) != 0)
    return labelled.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "runs")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.new_folder(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2, folder)
    return tokenfiles.read(spark, folder)


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"),
    )


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
}
_SQL_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM t"
    for rank, (kind, pattern) in enumerate(_SQL_PATTERNS.items())
)
ORACLES["op6_pii"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_SQL_MATCHES}),
u AS (SELECT doc_id, kind, rank, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
spans AS (
  SELECT doc_id, kind, rank, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
         regexp_replace(hits[i], ' ', '', 'g') AS plain,
         CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) AS BIGINT)
           + CAST(coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS begin
  FROM u
), valid AS (
  SELECT * FROM spans WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN (length(digits) - k) % 2 = 0 THEN CAST(digits[k] AS INT)
           ELSE (2 * CAST(digits[k] AS INT)) // 10 + (2 * CAST(digits[k] AS INT)) % 10 END)) % 10 = 0
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(plain[5:] || plain[1:4], ''),
      lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),
      lambda acc, v: (acc * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    ELSE TRUE END
), lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || begin || ':' || (begin + length(hit)), ',' ORDER BY begin, rank) AS spans,
         string_agg(kind || ':' || begin || ':' || (begin + length(hit)), ',' ORDER BY begin, rank) FILTER (kind <> 'iban') AS base
  FROM valid GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip,
       CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN lists USING (doc_id)
"""


@query
def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op7_maxscore"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op8_decontamination"] = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')
  FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'b' GROUP BY id),
held AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles b ON d.kind = 'd' AND b.kind = 'b' AND d.s = b.s GROUP BY 1, 2
)
SELECT doc_id, item_id, n_item, n_shared FROM held JOIN sizes ON id = item_id WHERE 4 * n_shared >= 3 * n_item
"""


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


ORACLES["op5_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
held AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM held JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)
), edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) ON u = d.doc_id
"""


@query
def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], given.schema)
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    nodes, paths = chat.format_chats(given.unionAll(added), tokenizer)
    return chat.read_back(nodes, paths, tokenizer)


ORACLES["op9_chat_tree"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
                 ELSE 1 + 2 * length(role) - length(translate(role, '\:#<', '')) END
            + 2 * length(text) - length(translate(text, '\#<', '')) + length('### : ') + length(' </turn>') + 1 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query
def op10_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations damaged by a hash of conversation and turn: rows dropped,
    emptied, stripped of sentence ends, doubled, or given to the user."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = (F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20).alias("harm")
    rows = conversations.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), harm)
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))
    return rows.filter("harm <> 0").select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")


@query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    repaired = turnrepair.repair(damaged(given))
    every = given.filter("conv_id IS NOT NULL").select("conv_id").distinct()
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return every.join(repaired, "conv_id", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in turnrepair.COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(said, F.lit("")), 256).alias("repaired_sha256"),
    )


# The states of a role sequence are the four entries of a list, each the least
# (cost, audit, repaired turns); a list of rows folds over them.
_SPACE = r"\x20\x09-\x0D"
_BEST = "list_min(list_filter([{}], lambda o: o.cost IS NOT NULL))"
_EDIT = "{{'cost': {s}.cost + {price}, 'audit': {s}.audit || '{letter}', 'said': list_append({s}.said, {turn})}}"


def _edit(state: str, price: str, letter: str, turn: str) -> str:
    return _EDIT.format(s=state, price=price, letter=letter, turn=turn)


def _drop(state: str) -> str:
    return f"{{'cost': {state}.cost + 4, 'audit': {state}.audit || 'D', 'said': {state}.said}}"


_INSERT_USER = "[s[1], s[2], " + _BEST.format(", ".join(["s[3]"] + [_edit(f"s[{i}]", "3", "I", "'user:'") for i in (1, 2, 4)])) + ", s[4]]"
_INSERT_ASSISTANT = "[u[1], u[2], u[3], " + _BEST.format("u[4], " + _edit("u[3]", "3", "I", "'assistant:'")) + "]"
_KEPT = "r.role || ':' || r.text"
_ROW = "[" + ", ".join([
    _drop("p[1]"),
    _BEST.format(_drop("p[2]") + ", " + _edit("p[1]", "r.keep_s", "K", _KEPT)),
    _BEST.format(", ".join(
        [_drop("p[3]")] + [_edit(f"p[{i}]", "r.keep_u", "K", _KEPT) for i in (1, 2, 4)]
        + [_edit(f"p[{i}]", "r.rerole", "R", "'user:' || r.text") for i in (1, 2, 4)]
    )),
    _BEST.format(", ".join([
        _drop("p[4]"), _edit("p[3]", "r.keep_a", "K", _KEPT), _edit("p[3]", "r.rerole", "R", "'assistant:' || r.text"),
    ])),
]) + "]"
_STATE = "STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[])"
_FIRST = f"[{{'cost': 0, 'audit': '', 'said': []}}, NULL, NULL, NULL]::{_STATE}[]"


def _with(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value: a list of one, transformed."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


_STEP = _with("u", _INSERT_USER, _with("p", _INSERT_ASSISTANT, _ROW))
_LAST = _with("u", _INSERT_USER, _INSERT_ASSISTANT)

_CRC32 = """xor(list_reduce(list_transform(string_split(conv_id || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce(range(8), lambda v, k: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLES["op13_turn_repair"] = rf"""
WITH damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32} % 20 AS harm
        FROM conversations WHERE conv_id IS NOT NULL)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_SPACE}]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][{_SPACE}]*$') THEN 'truncated' ELSE 'sound' END AS fault,
         coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
  FROM placed
), priced AS (
  SELECT *, CASE WHEN fault = 'sound' THEN 0 WHEN fault = 'truncated' THEN 3 END::BIGINT AS keep FROM judged
), folded AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (illegal) AS illegal,
         list_reduce(
           list({{'role': role, 'text': text, 'rerole': keep + 3, 'keep_s': CASE WHEN role[1] = 's' THEN keep END,
                 'keep_u': CASE WHEN role[1] = 'u' THEN keep END, 'keep_a': CASE WHEN role[1] = 'a' THEN keep END}} ORDER BY k),
           lambda s, r: {_STEP}, {_FIRST}) AS s
  FROM priced GROUP BY conv_id
), ended AS (SELECT * REPLACE ({_LAST} AS s) FROM folded),
best AS (SELECT *, {_BEST.format("s[1], s[4]")} AS b FROM ended)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) LEFT JOIN best USING (conv_id)
"""


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secretscan.BASE))
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in secretscan.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("secrets")).alias("spans"),
    )


# The base kinds, which are all that the given tables hold; encoded keys and
# tokens are tested on keys made for it.
_EITHER = "".join(f"|{name}" for name in ("password", "passwd", "secret", "token", "api_?key"))[1:]
_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in _EITHER)
_SECRET_PATTERNS = {
    "assign": rf"""(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
}
_SECRET_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM t"
    for rank, (kind, pattern) in enumerate(_SECRET_PATTERNS.items())
)
ORACLES["op12_secret_scan"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_SECRET_MATCHES}),
u AS (SELECT doc_id, kind, rank, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
lengths AS (
  SELECT doc_id, kind, rank, i, hits[i] AS hit, length(gaps[i]) AS gap FROM u
), spans AS (
  SELECT *, CAST(sum(gap + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS until FROM lengths
), valid AS (
  SELECT doc_id, kind, rank, until - length(hit) AS begin, until FROM spans
  WHERE CASE kind WHEN 'hex' THEN length(hit) >= 24 WHEN 'access' THEN length(hit) >= 20
        ELSE length(regexp_extract(hit, '^(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6 END
), lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || begin || ':' || until, ',' ORDER BY begin, rank) AS spans
  FROM valid GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN lists USING (doc_id)
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])

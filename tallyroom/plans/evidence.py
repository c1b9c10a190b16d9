"""Evidence, lineage and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.functions import numbers, privacy, rates, text
from tallyroom.functions.money import display_tolerance
from tallyroom.operators import evidence, excerpts, graph, intervals, projection
from tallyroom.operators.skew import in_tasks
from tallyroom.plans.registry import cents, query, sql_cents, table
from tallyroom.sources import documents as docs
from tallyroom.session import written
from tallyroom.sources import tables_on_pages

TOTAL = sql_cents("o_totalprice")

# Lines of a document stand for its pages.
SQL_PAGES = r"""
pages_ AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS body FROM documents
)"""


def line_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")
    ).select("source_id", (F.col("pos") + 1).alias("page"), "text")


def facts_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One fact per page, quoting it exactly, with wider spaces, without spaces, by
    its numbers only, from the page before, or not at all."""
    p = line_pages(spark, sf)
    kind = (F.col("page") % 6)
    squeezed = F.regexp_replace("text", r"\s", "")
    digits = F.array_join(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), " / ")
    return p.select(
        F.concat_ws(":", F.col("source_id").cast("string"), F.col("page").cast("string")).alias("fact_id"),
        "source_id",
        F.when(kind == 4, F.col("page") - 1).otherwise(F.col("page")).alias("page"),
        F.when(kind == 1, F.replace("text", F.lit(" "), F.lit("  "))).when(kind == 2, squeezed).when(kind == 3, digits)
        .when(kind == 5, F.concat(F.lit("zzqx "), "text")).otherwise(F.col("text")).alias("excerpt"),
    )


# Number tokens and their tolerant patterns, for an engine without lookaround.
SQL_TOKEN = r"'(?:[0-9]{1,3}(?:[ ,\x{00A0}\x{202F}][0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?'"


def sql_canonical(tokens: str) -> str:
    compact = rf"list_transform({tokens}, lambda t: regexp_replace(t, '[\s\x{{00A0}}\x{{202F}}$()\x{{2212}}-]', '', 'g'))"
    return f'''list_transform({compact}, lambda c:
      CASE WHEN contains(c, ',') AND contains(c, '.') THEN
             CASE WHEN instr(reverse(c), ',') < instr(reverse(c), '.') THEN replace(replace(c, '.', ''), ',', '.') ELSE replace(c, ',', '') END
           WHEN contains(c, ',') AND len(string_split(c, ',')) = 2 AND length(split_part(c, ',', 2)) <> 3 THEN replace(c, ',', '.')
           ELSE replace(c, ',', '') END)'''


def sql_patterns(tokens: str) -> str:
    return rf'''list_transform({sql_canonical(tokens)}, lambda k:
      '(^|[^0-9])' || array_to_string(string_split(split_part(k, '.', 1), ''), '[\s,\x{{00A0}}\x{{202F}}]*')
      || CASE WHEN contains(k, '.') THEN '\s*[.,]\s*' || array_to_string(string_split(split_part(k, '.', 2), ''), '\s*') ELSE '' END || '($|[^0-9])')'''


SQL_TIERS = SQL_PAGES + rf''',
facts AS (
  SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(page AS VARCHAR) AS fact_id, doc_id, CASE WHEN page % 6 = 4 THEN page - 1 ELSE page END AS page,
    trim(CASE page % 6 WHEN 1 THEN replace(body, ' ', '  ') WHEN 2 THEN regexp_replace(body, '\s', '', 'g')
         WHEN 3 THEN array_to_string(regexp_extract_all(body, '[0-9]+'), ' / ') WHEN 5 THEN 'zzqx ' || body ELSE body END) AS excerpt
  FROM pages_
),
letters AS (SELECT doc_id, text AS doc, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS doc_al FROM documents),
m AS (
  SELECT f.fact_id, f.doc_id, excerpt, p.body AS page, doc, doc_al,
         trim(lower(regexp_replace(excerpt, '\s+', ' ', 'g'))) AS ws, regexp_replace(lower(excerpt), '[^\p{{L}}\p{{N}}]', '', 'g') AS al,
         {sql_patterns(f"regexp_extract_all(excerpt, {SQL_TOKEN})")} AS pats,
         list_transform(regexp_extract_all(excerpt, '[\p{{L}}]{{4,}}'), lambda w: lower(w)) AS words
  FROM facts f JOIN letters d ON d.doc_id = f.doc_id LEFT JOIN pages_ p ON p.doc_id = f.doc_id AND p.page = f.page
),
tiers AS (
  SELECT fact_id, doc_id, CASE
    WHEN page IS NULL THEN 'bad-page-number' WHEN excerpt = '' THEN 'no-excerpt' WHEN contains(page, excerpt) THEN 'verbatim'
    WHEN contains(trim(lower(regexp_replace(page, '\s+', ' ', 'g'))), ws) THEN 'normalized'
    WHEN al <> '' AND contains(regexp_replace(lower(page), '[^\p{{L}}\p{{N}}]', '', 'g'), al) THEN 'alnum'
    WHEN len(pats) > 0 AND len(list_filter(pats, lambda q: NOT regexp_matches(page, q))) = 0 THEN
      CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: contains(lower(page), w))) >= greatest(2, round_even(len(words) * 0.6, 0)) THEN 'row-bound' ELSE 'numbers-only' END
    WHEN al <> '' AND contains(doc_al, al) THEN 'wrong-page'
    WHEN len(pats) > 0 AND len(list_filter(pats, lambda q: NOT regexp_matches(doc, q))) = 0 THEN 'wrong-page'
    ELSE 'not-found' END AS tier
  FROM m
)'''


@query("page_split", f"""
WITH {SQL_PAGES}
SELECT doc_id, CAST(page AS INTEGER) AS page, length(body) AS chars, md5(body) AS body_md5 FROM pages_
""")
def page_split(spark: SparkSession, sf: str) -> DataFrame:
    # Give every line a printed page marker, then split on the markers.
    marked = table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(
            F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("===== PAGE "), (i + 1).cast("string"), F.lit(" ====="), line)), ""
        ).alias("text"),
    )
    return docs.split_pages(marked, "doc_id", "text").select(
        "doc_id", "page", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("body_md5")
    )


@query("citation_audit", f"WITH {SQL_TIERS} SELECT fact_id, tier FROM tiers")
def citation_audit(spark: SparkSession, sf: str) -> DataFrame:
    whole = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return evidence.citation_tiers(written(facts_on_pages(spark, sf)), line_pages(spark, sf), whole)


@query("evidence_coverage", f"""
WITH {SQL_TIERS}
SELECT t.doc_id AS source_id, count(*) AS counted, count(CASE WHEN tier IN ('verbatim', 'normalized', 'alnum', 'row-bound') THEN 1 END) AS strong,
  CAST(count(CASE WHEN tier IN ('verbatim', 'normalized', 'alnum', 'row-bound') THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS coverage,
  CASE WHEN CAST(count(CASE WHEN tier IN ('verbatim', 'normalized', 'alnum', 'row-bound') THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) >= CAST(0.9 AS DOUBLE) THEN 'published' ELSE 'refused' END AS status
FROM tiers t JOIN labels q ON q.doc_id = t.doc_id AND quality = 1 GROUP BY 1
""")
def evidence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    tiers = citation_audit(spark, sf).withColumn("source_id", F.split("fact_id", ":")[0].cast("bigint"))
    labelled = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("source_id"))
    bearing = facts_on_pages(spark, sf).join(labelled, "source_id", "left_semi").select("fact_id")
    return evidence.evidence_coverage(tiers, bearing, ["source_id"])


@query("excerpt_repeats", f"""
WITH {SQL_PAGES},
f AS (
  SELECT doc_id, page, body AS excerpt FROM pages_ WHERE trim(body) <> ''
)
SELECT f.doc_id, CAST(f.page AS INTEGER) AS page, count(p.page) AS other_pages, CAST(min(p.page) AS INTEGER) AS first_other
FROM f JOIN pages_ p ON p.doc_id = f.doc_id AND p.page <> f.page AND p.body = f.excerpt GROUP BY 1, 2
""")
def excerpt_repeats(spark: SparkSession, sf: str) -> DataFrame:
    pages = line_pages(spark, sf).withColumnRenamed("source_id", "doc_id")
    return excerpts.repeated_on_other_pages(pages, "doc_id", "page", "text")


SQL_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"


@query("excerpt_search", f"""
WITH {SQL_PAGES},
f AS (
  SELECT doc_id, page, CASE WHEN page % 7 = 0 THEN 'zzqx ' || body ELSE upper(substr(body, 1 + length(body) // 4, 8 + length(body) // 3)) END AS excerpt FROM pages_
),
e AS (SELECT doc_id, page, {SQL_LETTERS.format('excerpt')} AS shown FROM f),
p AS (SELECT doc_id, page, {SQL_LETTERS.format('body')} AS shown FROM pages_),
hits AS (SELECT e.doc_id, e.page, count(*) AS pages, min(p.page) AS first_page FROM e JOIN p ON p.doc_id = e.doc_id AND e.shown <> '' AND contains(p.shown, e.shown) GROUP BY 1, 2)
SELECT e.doc_id, CAST(e.page AS INTEGER) AS page, coalesce(pages, 0) AS pages, CAST(first_page AS INTEGER) AS first_page,
       CASE WHEN shown = '' THEN 'nothing to find' WHEN first_page IS NULL THEN 'not found' WHEN first_page = e.page THEN 'on its page' ELSE 'first on another page' END AS status
FROM e LEFT JOIN hits USING (doc_id, page)
""")
def excerpt_search(spark: SparkSession, sf: str) -> DataFrame:
    """A piece of every page in capitals, without its page, searched in all pages of its document."""
    pages = line_pages(spark, sf).withColumnRenamed("source_id", "doc_id")
    size = F.length("text")
    piece = F.upper(F.substring("text", (F.floor(size / 4) + 1).cast("int"), (F.floor(size / 3) + 8).cast("int")))
    quoted = pages.select(
        F.col("page").alias("excerpt_id"), "doc_id", F.when(F.col("page") % 7 == 0, F.concat(F.lit("zzqx "), "text")).otherwise(piece).alias("excerpt")
    )
    hits = excerpts.located(pages, quoted, ["doc_id"], ["page"], every=False).groupBy("doc_id", "excerpt_id").agg(
        F.count(F.lit(1)).alias("pages"), F.min("page").alias("first_page")
    )
    asked = quoted.select("doc_id", "excerpt_id", F.col("excerpt").rlike(r"[\p{L}\p{N}]").alias("_shown"))
    return asked.join(hits, ["doc_id", "excerpt_id"], "left").select(
        "doc_id", F.col("excerpt_id").alias("page"), F.coalesce("pages", F.lit(0).cast("bigint")).alias("pages"), "first_page",
        F.when(~F.col("_shown"), "nothing to find").when(F.col("first_page").isNull(), "not found")
        .when(F.col("first_page") == F.col("excerpt_id"), "on its page").otherwise("first on another page").alias("status"),
    )


@query("excerpt_coverage", r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\s]+') AS words FROM documents),
e AS (SELECT DISTINCT doc_id, text, CASE k WHEN 3 THEN 'qzx' WHEN 4 THEN words[1] ELSE words[1 + (doc_id + k * 7) % len(words)] || ' ' || coalesce(words[2 + (doc_id + k * 7) % len(words)], '') END AS excerpt
      FROM w, (VALUES (0), (1), (2), (3), (4)) AS k(k) WHERE len(words) > 0),
p AS (SELECT doc_id, excerpt, string_split(text, excerpt) AS gaps FROM e WHERE NOT contains(substr(excerpt, 2), excerpt[1])),
u AS (SELECT doc_id, excerpt, gaps, unnest(range(1, len(gaps))) AS i FROM p WHERE len(gaps) > 1),
g AS (SELECT doc_id, excerpt, i, length(gaps[i]) AS gap FROM u),
s AS (SELECT doc_id, CAST(sum(gap + length(excerpt)) OVER (PARTITION BY doc_id, excerpt ORDER BY i) - length(excerpt) AS BIGINT) AS a, length(excerpt) AS n FROM g),
m AS (SELECT *, max(a + n) OVER (PARTITION BY doc_id ORDER BY a, a + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT doc_id, count(*) AS intervals, count(CASE WHEN reach IS NULL OR a > reach THEN 1 END) AS islands,
       CAST(sum(greatest(0, a + n - greatest(a, coalesce(reach, a)))) AS BIGINT) AS covered FROM m GROUP BY 1
""")
def excerpt_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of every document the places of some of its word pairs cover, and those of its first word."""
    whole = table(spark, sf, "documents").select("doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\f\r]+"), F.lit(0))
    at = lambda k: (F.col("doc_id") + k * 7) % F.size("words")
    word = lambda at: F.get("words", at.cast("int"))
    pair = lambda k: F.concat(word(at(k)), F.lit(" "), F.coalesce(word(at(k) + 1), F.lit("")))
    quoted = whole.select("doc_id", words.alias("words")).filter(F.size("words") > 0).select(
        "doc_id", F.explode(F.array_distinct(F.array(pair(0), pair(1), pair(2), F.lit("qzx"), word(F.lit(0))))).alias("excerpt")
    ).withColumn("excerpt_id", F.md5("excerpt"))
    # Such a piece cannot overlap itself, which the check does not count.
    quoted = quoted.filter(~F.contains(F.substring("excerpt", 2, 1 << 30), F.substring("excerpt", 1, 1)))
    spans = excerpts.located(whole, quoted, ["doc_id"], [], form="exact")
    return intervals.union_length(spans, "doc_id", chunk_width=4096)


@query("row_bound", f"""
WITH {SQL_PAGES},
f AS (SELECT doc_id, page, body, regexp_extract_all(body, '[0-9]+') AS nums, list_transform(regexp_extract_all(body, '[\\p{{L}}]{{4,}}'), lambda w: lower(w)) AS words FROM pages_)
SELECT doc_id, CAST(page AS INTEGER) AS page FROM f
WHERE len(words) >= 2 AND len(nums) > 0 AND page % 3 <> 0
""")
def row_bound(spark: SparkSession, sf: str) -> DataFrame:
    # Each line is cited against a page that holds it whole, or broken in two by
    # a form feed after its last letter or digit: then no row holds all of it.
    pages = line_pages(spark, sf)
    digits, letters = F.regexp_replace("text", r"[^0-9.,\s]", ""), F.regexp_replace("text", "[0-9]", "")
    page = F.when(F.col("page") % 3 != 0, F.concat(F.lit("Total 1\f"), F.col("text"), F.lit("\x0bend"))).otherwise(
        F.concat(digits, F.lit("\f"), letters)
    )
    facts = pages.select(F.struct("source_id", "page").alias("fact_id"), "source_id", "page", F.col("text").alias("excerpt"), page.alias("shown"))
    held = evidence.row_bound(facts.drop("shown"), facts.select("source_id", "page", F.col("shown").alias("text")), ["source_id", "page"])
    return held.select(F.col("fact_id.source_id").alias("doc_id"), "fact_id.page")


@query("number_tokens", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {SQL_TOKEN}) AS toks FROM documents),
c AS (SELECT doc_id, toks, {sql_canonical('toks')} AS canon FROM t)
SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS token, unnest(canon) AS canonical FROM c
""")
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(numbers.number_tokens(F.col("text"))).alias("pos", "token"))
    return rows.withColumn("canonical", numbers.canonical_number(F.col("token")))


def sql_stretch(number: str) -> str:
    """A pattern for a plain number in a text whose digit groups stand between marks."""
    whole = rf"array_to_string(string_split(split_part({number}, '.', 1), ''), '(?:\x02[\s,\x{{00A0}}\x{{202F}}]*\x01)?')"
    part = rf"array_to_string(string_split(split_part({number}, '.', 2), ''), '(?:\x02\s*\x01)?')"
    return rf"'\x01' || {whole} || CASE WHEN contains({number}, '.') THEN '\x02\s*[.,]\s*\x01' || {part} ELSE '' END || '\x02'"


def sql_signs(text: str, pattern: str) -> str:
    """Matches of a pattern in all, and those with a negative sign."""
    negative = rf"'(?:[-\x{{2212}}]\s*\$?\s*' || {pattern} || '|\(\s*\$?\s*' || {pattern} || '\s*\))'"
    return f"len(regexp_extract_all({text}, {pattern})) AS n, len(regexp_extract_all({text}, {negative})) AS negative"


@query("amount_binding", rf"""
WITH t AS (
  SELECT doc_id, text || chr(10) || 'net (' || (doc_id % 97) || ') or -$ ' || (1000 + doc_id) || '; about ' || (doc_id % 90 + 1) || '.5 million and ' || (doc_id % 9 + 1) || ' K' AS page,
         {sql_canonical(f"regexp_extract_all(text, {SQL_TOKEN})")} AS found FROM documents
), tokens AS (
  SELECT DISTINCT doc_id, TRY_CAST(k AS DECIMAL(38, 8)) AS v FROM (SELECT doc_id, unnest(list_filter(found, lambda k: length(split_part(k, '.', 1)) <= 28 AND length(split_part(k, '.', 2)) <= 8)) AS k FROM t)
), facts AS (
  SELECT doc_id, kind, CASE kind WHEN 'negated' THEN -v WHEN 'shifted' THEN v + 0.25 ELSE v END AS amount, CASE kind WHEN 'unscaled' THEN 0 END AS scale, abs(CASE kind WHEN 'shifted' THEN v + 0.25 ELSE v END) AS shown
  FROM tokens, (VALUES ('printed'), ('negated'), ('thousands'), ('shifted'), ('unscaled')) AS c(kind)
  UNION ALL SELECT doc_id, kind, v * s, NULL, v
  FROM (SELECT doc_id, unnest([CAST(doc_id % 97 AS DECIMAL(38, 8)), 1000 + doc_id, (doc_id % 90 + 1.5) * 1000000, (doc_id % 9 + 1) * 1000]) AS v, unnest(['bracket', 'minus', 'worded', 'letter']) AS kind FROM documents),
       (VALUES (1), (-1)) AS c(s)
), unread AS (
  SELECT DISTINCT doc_id, 'printed' AS kind, k AS amount FROM (SELECT doc_id, unnest(found) AS k FROM t) WHERE length(split_part(k, '.', 1)) > 28 OR length(split_part(k, '.', 2)) > 8
), numbers AS (
  SELECT doc_id, kind, amount, FALSE AS worded, CAST(CAST(round(shown, 2) AS DECIMAL(38, 2)) AS VARCHAR) AS number FROM facts
  UNION ALL SELECT doc_id, kind, amount, FALSE, CAST(CAST(shown AS DECIMAL(38, 0)) AS VARCHAR) FROM facts WHERE shown = floor(shown)
  UNION ALL SELECT doc_id, kind, amount, TRUE, regexp_replace(CAST(CAST(shown / size AS DECIMAL(38, 1)) AS VARCHAR), '\.0$', '') || ' ' || word
  FROM facts, (VALUES (1000000000, 'billion'), (1000000000, 'B'), (1000000, 'million'), (1000000, 'M'), (1000, 'thousand'), (1000, 'K')) AS m(size, word)
  WHERE shown >= size AND shown % (size // 10) = 0
), matched AS (
  SELECT doc_id, kind, amount, worded, {sql_signs("regexp_replace(page, '([0-9]+)', chr(1) || chr(92) || '1' || chr(2), 'g')", sql_stretch("number"))} FROM numbers JOIN t USING (doc_id) WHERE NOT worded
  UNION ALL SELECT doc_id, kind, amount, worded, {sql_signs("page", "p")}
  FROM (SELECT *, replace(split_part(number, ' ', 1), '.', '\s*[.,]\s*') || '\s*(?:-|\x{{2013}})?\s*' || CASE WHEN length(split_part(number, ' ', 2)) = 1 THEN split_part(number, ' ', 2) || '\b' ELSE '(?i:' || split_part(number, ' ', 2) || ')' END AS p
        FROM numbers WHERE worded) JOIN t USING (doc_id)
), held AS (
  SELECT doc_id, kind, amount, worded, sum(negative) > 0 AS minus, sum(n) > sum(negative) AS plus FROM matched WHERE n > 0 GROUP BY ALL
), best AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY doc_id, kind, amount ORDER BY worded) = 1)
SELECT f.doc_id, f.kind, CAST(f.amount AS VARCHAR) AS amount, CASE WHEN f.amount = 0 THEN 'bound' WHEN scale = 0 THEN 'scale-factor-invalid' WHEN b.doc_id IS NULL THEN 'amount-not-on-cited-page'
  WHEN NOT CASE WHEN f.amount < 0 THEN minus ELSE plus END THEN 'amount-sign-mismatch' ELSE 'bound' END AS status
FROM (SELECT DISTINCT doc_id, kind, amount, scale FROM facts) f LEFT JOIN best b ON b.doc_id = f.doc_id AND b.kind = f.kind AND b.amount = f.amount
UNION ALL SELECT doc_id, kind, amount, 'amount-out-of-range' FROM unread
""")
def amount_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Every printed number of a document as an amount: as it stands, negated, in
    thousands, shifted off the page, and with an unsound scale; and figures that the
    page ends with, in brackets, behind a minus, and in words, with both signs. A
    number that no amount can hold is refused by name."""
    whole = table(spark, sf, "documents").select("doc_id", "text")
    number = lambda n: n.cast("string")
    doc = F.col("doc_id")
    page = F.concat(
        "text", F.lit("\nnet ("), number(doc % 97), F.lit(") or -$ "), number(doc + 1000), F.lit("; about "), number(doc % 90 + 1),
        F.lit(".5 million and "), number(doc % 9 + 1), F.lit(" K"),
    )
    tokens = whole.select("doc_id", F.explode(F.array_distinct(F.transform(numbers.number_tokens(F.col("text")), numbers.canonical_number))).alias("k"))
    readable = (F.length(F.substring_index("k", ".", 1)) <= 28) & (~F.col("k").contains(".") | (F.length(F.substring_index("k", ".", -1)) <= 8))
    v, none = F.col("v"), F.lit(None).cast("decimal(10,0)")
    case = lambda kind, amount, scale=none: F.struct(F.lit(kind).alias("kind"), amount.cast("decimal(38,8)").alias("amount"), scale.cast("decimal(10,0)").alias("scale"))
    printed = tokens.filter(readable).select("doc_id", F.col("k").cast("decimal(38,8)").alias("v")).distinct().select("doc_id", F.explode(F.array(
        case("printed", v), case("negated", -v), case("thousands", v.cast("decimal(36,6)") * 1000, F.lit(1000)), case("shifted", v + F.lit("0.25").cast("decimal(4,2)")), case("unscaled", v, F.lit(0)),
    )).alias("c"))
    signed = lambda kind, amount: [case(kind, amount), case(kind, -amount)]
    added = whole.select("doc_id", F.explode(F.array(
        *signed("bracket", doc % 97), *signed("minus", doc + 1000), *signed("worded", (doc % 90) * 1_000_000 + 1_500_000), *signed("letter", (doc % 9 + 1) * 1000),
    )).alias("c"))
    facts = printed.unionByName(added).select("doc_id", "c.*").distinct().withColumn("fact_id", F.struct("doc_id", "kind", "amount"))
    judged = evidence.amount_issues(facts, whole.select("doc_id", page.alias("text")), ["doc_id"])
    shown = F.when(F.col("kind") == "thousands", (F.col("amount") / 1000).cast("decimal(38,8)")).otherwise(F.col("amount"))
    return judged.select("fact_id.*", F.coalesce("issue", F.lit("bound")).alias("status")).select("doc_id", "kind", shown.cast("string").alias("amount"), "status").unionByName(
        tokens.filter(~readable).select("doc_id", F.lit("printed").alias("kind"), F.col("k").alias("amount"), F.lit("amount-out-of-range").alias("status"))
    )


@query("deep_link", """
SELECT page_id, CASE WHEN regexp_matches(html, 'lang="en"') THEN url || '#page=' || CAST(page_id % 9 + 1 AS VARCHAR) ELSE url END AS link FROM pages
""")
def deep_link(spark: SparkSession, sf: str) -> DataFrame:
    verified = F.col("html").rlike('lang="en"')
    return table(spark, sf, "pages").select("page_id", evidence.deep_link(F.col("url"), F.col("page_id") % 9 + 1, verified).alias("link"))


SQL_VALUE = f"""
p AS (
  SELECT o_orderkey AS path, o_custkey AS node_id, o_totalprice AS amount,
         CASE WHEN o_orderpriority = '1-URGENT' THEN c_acctbal END AS sibling,
         CASE WHEN o_orderpriority = '2-HIGH' THEN c_acctbal END AS rate,
         CASE WHEN o_orderstatus <> 'P' THEN 100.0 END AS assessment, o_orderpriority AS pr, c_acctbal AS v
  FROM orders JOIN customer ON c_custkey = o_custkey
),
q AS (SELECT *, CASE WHEN pr = '3-MEDIUM' THEN v + 0.01 WHEN pr = '2-HIGH' AND path % 2 = 0 THEN v * 100 ELSE amount END AS a FROM p)"""


@query("value_binding", f"""
WITH {SQL_VALUE}
SELECT path, node_id, CASE WHEN abs(a - v) <= 0.011 THEN 'bound' WHEN sibling IS NOT NULL THEN 'bound-by-sibling'
  WHEN rate IS NOT NULL AND assessment IS NULL THEN 'rate without an assessment in scope'
  WHEN rate IS NOT NULL AND abs(a - round(v * 100, 2)) <= 0.011 THEN 'bound-by-rate'
  WHEN rate IS NOT NULL THEN 'rate times assessment is not the printed amount' ELSE 'printed amount does not equal its node' END AS status FROM q
""")
def value_binding(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("value"))
    pr, v = F.col("o_orderpriority"), F.col("value")
    # The artifact prints its own copies of the node value: as a sibling, as a rate.
    cited = table(spark, sf, "orders").withColumnRenamed("o_custkey", "node_id").join(nodes, "node_id")
    printed = cited.select(
        F.col("o_orderkey").alias("path"), F.col("node_id").alias("cited_id"),
        F.when(pr == "3-MEDIUM", v + F.lit(0.01)).when((pr == "2-HIGH") & (F.col("o_orderkey") % 2 == 0), v * 100).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(pr == "1-URGENT", v).alias("sibling"), F.when(pr == "2-HIGH", v).alias("rate"),
        F.when(F.col("o_orderstatus") != "P", F.lit(100.0)).alias("assessment"),
    )
    return evidence.value_binding(printed, nodes)


@query("derived_recompute", """
WITH v AS (
  SELECT o_orderkey AS derived_id, o_orderstatus AS st, o_orderpriority AS pr, CAST(round(o_totalprice * 100) AS BIGINT) AS t, CAST(round(c_acctbal * 100) AS BIGINT) AS b
  FROM orders JOIN customer ON c_custkey = o_custkey
)
SELECT derived_id, CASE WHEN pr = '1-URGENT' THEN 'formula input is missing' WHEN pr = '5-LOW' AND st = 'O' THEN 'division by zero'
  WHEN pr = '2-HIGH' AND st = 'F' THEN 'identity fails' WHEN st = 'P' THEN 'does not recompute'
  WHEN pr = '4-NOT SPECIFIED' AND (t + b) % 200 <> 0 THEN 'does not recompute' ELSE 'recomputed' END AS status FROM v
""")
def derived_recompute(spark: SparkSession, sf: str) -> DataFrame:
    """Each order derives the mean of its total and its customer's balance."""
    money = lambda c: F.col(c).cast("decimal(20,2)")
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    nodes = orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"), money("o_totalprice").alias("value")).unionByName(
        customers.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"), money("c_acctbal").alias("value"))
    )
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    two = F.when((pr == "5-LOW") & (st == "O"), 0).otherwise(2).cast("decimal(20,2)")
    none = F.lit(None).cast("decimal(20,2)")

    def term(factor, numerator, sign, node, constant):
        return F.struct(
            F.lit(factor).alias("factor_no"), F.lit(numerator).alias("numerator"), F.lit(sign).alias("sign"),
            node.alias("input_id"), constant.alias("constant"),
        )

    total = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    balance = F.concat(F.when(pr == "1-URGENT", "missing").otherwise("c"), F.col("o_custkey").cast("string"))
    terms = orders.select(
        F.col("o_orderkey").alias("derived_id"),
        F.explode(F.array(term(1, True, 1, total, none), term(1, True, 1, balance, none), term(2, False, 1, F.lit(None).cast("string"), two))).alias("t"),
    ).select("derived_id", "t.*")
    stored = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey").select(
        F.col("o_orderkey").alias("derived_id"),
        ((money("o_totalprice") + money("c_acctbal")) / 2 + F.when(st == "P", 20).otherwise(0)).alias("exact"),
        F.when((pr == "2-HIGH") & (st == "F"), F.lit(-1.0e9)).when((pr == "2-HIGH") & (st == "O"), F.lit(0.4)).alias("off"), pr.alias("pr"),
    )
    # Shown in whole units, cut to whole units but shown in cents, or exact to the tenth of a cent.
    printed = (
        F.when(F.col("pr") == "3-MEDIUM", F.round("exact", 0).cast("decimal(20,0)").cast("string"))
        .when(F.col("pr") == "4-NOT SPECIFIED", (F.floor("exact") - F.when(F.col("exact") != F.floor("exact"), 1).otherwise(0)).cast("decimal(20,2)").cast("string"))
        .otherwise(F.col("exact").cast("decimal(20,3)").cast("string"))
    )
    stored = stored.withColumn("printed", printed).select(
        "derived_id", F.col("printed").cast("double").alias("stored"),
        display_tolerance(F.col("printed"), F.lit(True)).alias("tolerance"),
        # a control in whole units may be off by less than half of one
        F.when(F.col("off") < 0, F.col("off")).when(F.col("off") > 0, F.col("exact").cast("double") + F.col("off")).alias("control"),
        F.when(F.col("off") > 0, display_tolerance(F.lit("1"), F.lit(True))).alias("control_tolerance"),
    )
    return evidence.recompute(stored, terms, nodes, rows=3 * orders.count())


@query("exact_products", """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(round(min(l_extendedprice) * 100) AS BIGINT) AS p, CAST(round(min(l_discount) * 100) AS BIGINT) AS d,
  CAST(round(min(l_tax) * 100) AS BIGINT) AS t, l_orderkey % 4 AS k FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, l_linenumber, CASE WHEN k IN (0, 2) OR p * (100 - d) * (100 + t) = 0 AND k = 3 THEN 'recomputed' ELSE 'does not recompute' END AS status FROM l
""")
def exact_products(spark: SparkSession, sf: str) -> DataFrame:
    """The charge of each line number of an order (the least price, discount and tax
    where it repeats). What is stored is off
    by the tolerance (0, 2), by the smallest step beyond it (1), or has the wrong
    sign (3); the prices are in units of 10^10, where doubles no longer tell."""
    big = F.lit(10**10).cast("decimal(11,0)")
    money = lambda c: F.round(F.col(c) * 100).cast("decimal(12,0)")
    key = F.concat_ws("/", "l_orderkey", "l_linenumber")
    items = table(spark, sf, "lineitem")
    count = items.count()
    least = items.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_extendedprice", "l_discount", "l_tax")])
    lines = in_tasks(least, count, "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", key.alias("derived_id"), money("l_extendedprice").alias("p"), money("l_discount").alias("d"), money("l_tax").alias("t")
    )
    nodes = lines.select(F.concat(F.lit("p"), "derived_id").alias("node_id"), (F.col("p") * big).cast("decimal(34,16)").alias("value")).unionByName(
        lines.select(F.concat(F.lit("d"), "derived_id").alias("node_id"), (F.col("d") / 100).cast("decimal(34,16)").alias("value"))
    )
    none, one = F.lit(None).cast("string"), F.lit(1).cast("decimal(34,16)")

    def term(factor, numerator, sign, node, constant=F.lit(None).cast("decimal(34,16)")):
        return F.struct(F.lit(factor).alias("factor_no"), F.lit(numerator).alias("numerator"), F.lit(sign).alias("sign"), node.alias("input_id"), constant.alias("constant"))

    terms = lines.select("derived_id", F.explode(F.array(
        term(1, True, 1, F.concat(F.lit("p"), "derived_id")), term(2, True, 1, none, one), term(2, True, -1, F.concat(F.lit("d"), "derived_id")),
        term(3, True, 1, none, one + (F.col("t") / 100).cast("decimal(6,2)")), term(4, False, 1, none, F.lit(10).cast("decimal(34,16)")),
    )).alias("t")).select("derived_id", "t.*")
    charge = ((F.col("p") * (100 - F.col("d")) * (100 + F.col("t"))).cast("decimal(16,0)") * F.lit(10**5).cast("decimal(6,0)")).cast("decimal(20,0)")
    kind, step = F.col("l_orderkey") % 4, lambda text: F.lit(text).cast("decimal(16,16)")
    stored = F.when(kind == 0, charge + step("0.005")).when(kind == 1, charge + step("0.0050000000000001")).when(kind == 2, charge - step("0.005")).otherwise(-charge)
    derived = lines.select("derived_id", stored.cast("decimal(34,16)").alias("stored"), step("0.005").cast("decimal(34,16)").alias("tolerance"), F.lit(None).cast("double").alias("control"))
    parts = F.split("derived_id", "/")
    return evidence.recompute(derived, terms, nodes, rows=5 * count).select(parts[0].cast("bigint").alias("l_orderkey"), parts[1].cast("int").alias("l_linenumber"), "status")


@query("scope_asof", """
WITH h AS (SELECT n_nationkey, n_regionkey FROM nation)
SELECT 'd' AS doc, CAST(n_regionkey AS VARCHAR) || '/' || CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS path,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(round(o_totalprice * 100) AS BIGINT)
            WHEN c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN CAST(round(c_acctbal * 100) AS BIGINT)
            WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS BIGINT) END AS assessment,
       CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 4 WHEN c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN 3 WHEN n_nationkey % 2 = 0 THEN 2 END AS INTEGER) AS scope_depth
FROM orders JOIN customer ON c_custkey = o_custkey JOIN h ON n_nationkey = c_nationkey
""")
def scope_asof(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    customers = table(spark, sf, "customer").join(nation, "c_nationkey").withColumn("cpath", F.concat_ws("/", "n_regionkey", "c_nationkey", "c_custkey"))
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").join(customers.select("c_custkey", "cpath"), "c_custkey").select(
        F.lit("d").alias("doc"), F.concat_ws("/", "cpath", "o_orderkey").alias("path"), "o_orderpriority", cents("o_totalprice").alias("assessment")
    )
    holders = (
        nation.filter("c_nationkey % 2 = 0").select(F.lit("d").alias("doc"), F.concat_ws("/", "n_regionkey", "c_nationkey").alias("path"), F.col("c_nationkey").cast("bigint").alias("assessment"))
        .unionByName(customers.filter("c_acctbal > 0 AND c_mktsegment = 'BUILDING'").select(F.lit("d").alias("doc"), F.col("cpath").alias("path"), cents("c_acctbal").alias("assessment")))
        .unionByName(orders.filter("o_orderpriority = '1-URGENT'").select("doc", "path", "assessment"))
    )
    return evidence.scope_asof(orders.select("doc", "path"), holders, "doc", "path", "assessment")


# Part p derives from p div 2 and p div 3.
def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_partkey > 0")
    return p.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("dst"))


SQL_EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0)"


@query("lineage_closure", f"""
WITH RECURSIVE {SQL_EDGES},
c AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#7' UNION SELECT e.dst FROM c JOIN e ON e.src = c.node)
SELECT node FROM c
""")
def lineage_closure(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node"))
    return graph.reached(roots, part_edges(spark, sf))


@query("lineage_verified", f"""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey * 3 FROM part WHERE p_partkey > 0),
n AS (SELECT p_partkey AS node, p_size, p_partkey * 2 > (SELECT max(p_partkey) FROM part) AS leaf FROM part WHERE p_partkey > 0),
b AS (SELECT node FROM n WHERE leaf AND p_size <= 1 UNION SELECT e.src FROM b JOIN e ON e.dst = b.node),
g AS (SELECT node FROM n WHERE leaf AND p_size > 1 UNION SELECT e.src FROM g JOIN e ON e.dst = g.node)
SELECT node, node NOT IN (SELECT node FROM b) AND node IN (SELECT node FROM g) AS fully_verified, node IN (SELECT node FROM g) AS any_verified FROM n
""")
def lineage_verified(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").filter("p_partkey > 0")
    last = table(spark, sf, "part").agg(F.max("p_partkey").alias("last"))
    nodes = part.select(
        F.col("p_partkey").alias("node"), (F.col("p_partkey") * 2 > last.scalar()).alias("is_leaf"), (F.col("p_size") > 1).alias("verified")
    )
    edges = part.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 3)).alias("dst"))
    return graph.lineage_verified(nodes, edges)


SQL_CYCLE_EDGES = """e AS (
  SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0
  UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey > 0 AND p_brand = 'Brand#3' AND p_size < 10
  UNION SELECT p_partkey // 8, p_partkey FROM part WHERE p_partkey > 0 AND p_brand = 'Brand#5' AND p_size > 45
  UNION SELECT p_partkey, p_partkey FROM part WHERE p_size = 13 AND p_brand = 'Brand#9')"""


@query("cycle_nodes", f"""
WITH RECURSIVE {SQL_CYCLE_EDGES},
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT DISTINCT a AS node FROM r WHERE a = b
""")
def cycle_nodes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    real = part.filter("p_partkey > 0")
    edges = (
        real.selectExpr("p_partkey AS src", "p_partkey div 2 AS dst")
        .unionByName(real.filter("p_brand = 'Brand#3' AND p_size < 10").selectExpr("p_partkey div 2 AS src", "p_partkey AS dst"))
        .unionByName(real.filter("p_brand = 'Brand#5' AND p_size > 45").selectExpr("p_partkey div 8 AS src", "p_partkey AS dst"))
        .unionByName(part.filter("p_brand = 'Brand#9' AND p_size = 13").selectExpr("p_partkey AS src", "p_partkey AS dst"))
    )
    return graph.cyclic_nodes(edges)


@query("citation_resolve", """
WITH f AS (SELECT s_suppkey AS fact_id, CASE WHEN s_acctbal > 0 THEN s_name END AS url FROM supplier),
i AS (SELECT p_partkey + 1000000 AS node_id, 0 AS position, p_partkey % 50 AS input_id FROM part
      UNION ALL SELECT p_partkey + 1000000, CASE WHEN p_size > 40 THEN 1500 ELSE 1 END, (p_partkey // 7) % 50 FROM part UNION ALL SELECT p_partkey + 1000000, 2, p_partkey // 2 + 1000000 FROM part WHERE p_partkey > 0),
r AS (SELECT p_partkey AS ref_id, CASE WHEN p_size < 5 THEN p_partkey % 100 ELSE p_partkey + 1000000 END AS node_id FROM part),
a AS (
  SELECT ref_id, 0 AS level, 0 AS position, 0 AS p2, fact_id, url FROM r JOIN f ON fact_id = node_id
  UNION ALL SELECT ref_id, 1, position, 0, fact_id, url FROM r JOIN i USING (node_id) JOIN f ON fact_id = input_id
  UNION ALL SELECT ref_id, 2, i.position, j.position, fact_id, url FROM r JOIN i USING (node_id) JOIN i j ON j.node_id = i.input_id JOIN f ON fact_id = j.input_id
),
b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY level, position, p2, fact_id) AS k FROM a WHERE level = 0 OR url IS NOT NULL),
n AS (SELECT ref_id, count(DISTINCT fact_id) AS facts FROM a GROUP BY 1)
SELECT r.ref_id, b.fact_id AS primary_fact, b.url, CAST(b.level AS INTEGER) AS level, coalesce(facts, 0) AS facts
FROM r LEFT JOIN b ON b.ref_id = r.ref_id AND k = 1 LEFT JOIN n ON n.ref_id = r.ref_id
""")
def citation_resolve(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    facts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fact_id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("url"))
    node = F.col("p_partkey") + 1000000
    inputs = (
        part.select(node.alias("node_id"), F.lit(0).alias("position"), (F.col("p_partkey") % 50).alias("input_id"))
        .unionByName(part.select(node.alias("node_id"), F.when(F.col("p_size") > 40, 1500).otherwise(1).alias("position"), F.expr("(p_partkey div 7) % 50").alias("input_id")))
        .unionByName(part.filter("p_partkey > 0").select(node.alias("node_id"), F.lit(2).alias("position"), F.expr("p_partkey div 2 + 1000000").alias("input_id")))
    )
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.when(F.col("p_size") < 5, F.col("p_partkey") % 100).otherwise(node).alias("node_id"))
    return graph.primary_citation(refs, inputs, facts)


@query("name_normalize", """
SELECT doc_id, md5(regexp_replace(replace(lower(strip_accents(replace(lower(text), 'ß', 'ss'))), '&', ' and '), '[^a-z0-9]+', '', 'g')) AS name_md5 FROM documents
""")
def name_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalized_name(F.col("text"))).alias("name_md5"))


@query("slugify", """
WITH w AS (
  SELECT p_partkey AS code, list_filter(string_split(replace(replace(lower(p_name), '.', ''), '/', ' ') || ' ' || CASE WHEN p_size % 2 = 0 THEN 'tp' ELSE 'st' END, ' '), lambda x: x NOT IN ('', 'tp', 'c', 't', 'r', 'uco', 'st', 'lt', 'ut')) AS words FROM part
)
SELECT code, CASE WHEN len(words) > 0 THEN array_to_string(words, '-') ELSE 'muni-' || CAST(code AS VARCHAR) END || '-on' AS slug FROM w
""")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " Tp").otherwise(" ST"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("code"), text.slug(name, F.col("p_partkey").cast("string"), "-on").alias("slug"))


@query("name_parts", """
WITH n AS (SELECT p_partkey AS code, p_name AS stem, CASE p_size % 5 WHEN 0 THEN 'Tp' WHEN 1 THEN 'County' WHEN 2 THEN 'UCo' WHEN 3 THEN 'Zz' ELSE 'C' END AS suffix FROM part)
SELECT code, CASE suffix WHEN 'County' THEN stem || ' County' WHEN 'Zz' THEN NULL ELSE stem END AS display,
  CASE suffix WHEN 'Tp' THEN 'Township' WHEN 'County' THEN 'County' WHEN 'UCo' THEN 'United Counties' WHEN 'C' THEN 'City' END AS kind FROM n
""")
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 5
    suffix = F.when(k == 0, "Tp").when(k == 1, "County").when(k == 2, "UCo").when(k == 3, "Zz").otherwise("C")
    display, kind = text.filing_name_parts(F.concat("p_name", F.lit(" "), suffix))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("code"), display.alias("display"), kind.alias("kind"))


@query("date_normalize", """
WITH d AS (SELECT o_orderkey AS code, CAST(o_orderdate AS DATE) AS d, day(o_orderdate) AS dd FROM orders)
SELECT code, CASE WHEN dd <= 28 THEN CAST(d AS VARCHAR) END AS compact, CASE WHEN dd <= 12 THEN CAST(d AS VARCHAR) END AS slashed, dd % 2 = 0 AS has_offset FROM d
""")
def date_normalize(spark: SparkSession, sf: str) -> DataFrame:
    # Printed dates: compact with an impossible day after the 28th, day and month
    # with a slash and a bad form after the 12th, timestamps half without offset.
    d, dd = F.col("o_orderdate"), F.day("o_orderdate")
    compact = F.when(dd <= 28, F.date_format(d, "yyyyMMdd")).otherwise(F.concat(F.date_format(d, "yyyyMM"), F.lit("32")))
    slashed = F.when(dd <= 12, F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "d-M-yyyy"))
    stamped = F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.when(dd % 2 == 0, "-05:00").otherwise(""))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("code"), text.compact_date(compact).cast("string").alias("compact"), text.slash_date(slashed).cast("string").alias("slashed"),
        text.offset_timestamp(stamped).isNotNull().alias("has_offset"),
    )


@query("sensitive_text", r"""
WITH s AS (
  SELECT doc_id, concat_ws(',',
    CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}($|[^A-Za-z0-9.-])') THEN 'email address' END,
    CASE WHEN regexp_matches(text, '(^|[^0-9])(\+?1[\s.-]?)?\(?[2-9][0-9]{2}\)?[\s.-][0-9]{3}[\s.-][0-9]{4}($|[^0-9])') THEN 'telephone number' END,
    CASE WHEN regexp_matches(upper(text), '(^|[^A-Z0-9])[ABCEGHJ-NPRSTVXY][0-9][ABCEGHJ-NPRSTVWXYZ][ -]?[0-9][ABCEGHJ-NPRSTVWXYZ][0-9]($|[^A-Z0-9])') THEN 'postal code' END,
    CASE WHEN regexp_matches(lower(text), '([a-z]:[\\/](users|documents and settings)[\\/]|/(home|users)/[a-z0-9._-]+/)') THEN 'local path' END,
    CASE WHEN regexp_matches(text, '(-----BEGIN [A-Z ]*PRIVATE KEY-----|github_pat_[A-Za-z0-9_]{8,}|ghp_[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk-(proj-)?[A-Za-z0-9_-]{12,}|AKIA[0-9A-Z]{16}|Bearer\s+[A-Za-z0-9._~+/-]{16,})') THEN 'key or token' END) AS findings
  FROM documents
)
SELECT * FROM s WHERE findings <> ''
""")
def sensitive_text(spark: SparkSession, sf: str) -> DataFrame:
    found = privacy.sensitive_labels(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("findings")).filter("findings <> ''")


@query("handover_text", r"""
WITH s AS (
  SELECT doc_id, concat_ws(',',
    CASE WHEN regexp_matches(text, '(?i)((^|[^\p{L}\p{N}_])[a-z]:[\\/]|file://|\\\\[^\\\s]+\\|(^|[^a-z0-9])~[\\/]|(^|[^a-z0-9:/])/(users|home|tmp|var|etc|opt|root|private|volumes|mnt|srv|workspace)/)') THEN 'local path' END,
    CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])(sk-(ant-|proj-)?[A-Za-z0-9_-]{20,}|xai-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{25,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{20,}|(?i:bearer)\s+[A-Za-z0-9._~+/-]{20,}=*|(?i:basic)\s+[A-Za-z0-9+/]{16,}={0,2}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})($|[^\p{L}\p{N}_])')
      OR regexp_matches(text, '(?i)((^|[^\p{L}\p{N}_])(password|passwd|pwd|secret|token)\s*[:=]\s*[^\s,;]{8,}|[?&](sig|signature|token)=[a-z0-9%._~+/-]{16,})')
      OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'credential' END,
    CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}($|[^A-Za-z0-9._%+-])') THEN 'email address' END,
    CASE WHEN regexp_matches(text, '(?i)(^|[^a-z0-9])(\+?1[\s.-]?)?(\([2-9][0-9]{2}\)[\s.-]?|[2-9][0-9]{2}[\s.-]?)[2-9][0-9]{2}[\s.-]?[0-9]{4}(\s*(x|ext\.?)\s*[0-9]{1,6})?($|[^a-z0-9])') THEN 'telephone number' END) AS findings
  FROM documents
)
SELECT * FROM s WHERE findings <> ''
""")
def handover_text(spark: SparkSession, sf: str) -> DataFrame:
    found = F.filter(privacy.handover_labels(F.col("text")), lambda label: label != "checksum id")
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("findings")).filter("findings <> ''")


@query("luhn_ids", r"""
WITH c AS (SELECT event_id, lpad(CAST((event_id * 7919 + user_id * 104729 + 123456789) % 1000000000 AS VARCHAR), 9, '0') AS d FROM events),
s AS (SELECT event_id, d, list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 0 THEN (CAST(substr(d, i, 1) AS INTEGER) * 2) // 10 + (CAST(substr(d, i, 1) AS INTEGER) * 2) % 10 ELSE CAST(substr(d, i, 1) AS INTEGER) END)) AS total FROM c)
SELECT event_id FROM s WHERE total % 10 = 0
""")
def luhn_ids(spark: SparkSession, sf: str) -> DataFrame:
    number = F.lpad(((F.col("event_id") * 7919 + F.col("user_id") * 104729 + 123456789) % 1000000000).cast("string"), 9, "0")
    note = F.concat(F.lit("id "), F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 3), F.lit(" "), F.substring(number, 7, 3), F.lit("."))
    return table(spark, sf, "events").filter(privacy.has_checksum_id(note)).select("event_id")


@query("format_rules", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, host, starts_with(url, 'https://') AS is_https, (host = 'example.org' OR host LIKE '%.example.org') AS in_domain,
       regexp_matches(regexp_extract(url, '/([a-z]{2})/', 1), '^[a-z]{2,3}(-[A-Z]{2})?$') AS has_language FROM u
""")
def format_rules(spark: SparkSession, sf: str) -> DataFrame:
    host = F.try_parse_url("url", F.lit("HOST"))
    return table(spark, sf, "pages").select(
        "page_id", host.alias("host"), F.col("url").startswith("https://").alias("is_https"),
        text.host_in_domains(host, ["example.org"]).alias("in_domain"),
        F.regexp_extract("url", "/([a-z]{2})/", 1).rlike(text.LANGUAGE_FORM).alias("has_language"),
    )


@query("denied_keys", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'User-ID' ELSE 'e_mail' END AS found_key FROM events WHERE event_type IN ('error', 'signup')
""")
def denied_keys(spark: SparkSession, sf: str) -> DataFrame:
    # Nest the properties and name the user the way different producers do.
    name = F.when(F.col("event_type") == "error", "User-ID").when(F.col("event_type") == "signup", "e_mail").otherwise("kind")
    doc = F.concat(F.lit('{"props": '), "props", F.lit(', "list": [{"'), name, F.lit('" : "a \\"email\\": b", "n": 1}]}'))
    rows = table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return projection.denied_keys(rows, "doc", ["userid", "email"]).select("event_id", "found_key")


@query("rate_row_extract", r"""
SELECT o_orderkey AS code, CAST(43743 + o_custkey % 7 AS BIGINT) AS city, CASE o_orderstatus WHEN 'F' THEN 'percent' WHEN 'O' THEN 'mill' END AS unit,
  CASE WHEN o_orderstatus = 'P' THEN 'ambiguous unmarked rate' WHEN o_orderpriority = '5-LOW' THEN 'rates do not add to the total' END AS reason
FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL SELECT -o_orderkey, 12345, 'decimal', CASE o_custkey % 3 WHEN 1 THEN 'rates do not add to the total' WHEN 2 THEN 'rate has too many digits' END FROM orders
""")
def rate_row_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Each order prints a rate table on a page; one row of it is residential."""
    city = 43743 + F.pmod(F.col("o_custkey"), F.lit(7))
    unit = F.when(F.col("o_orderstatus") == "F", " %").when(F.col("o_orderstatus") == "O", " mills").otherwise("")
    show = lambda n: F.concat((n.cast("decimal(10,0)") / F.lit(100000).cast("decimal(6,0)")).cast("decimal(12,5)").cast("string"), unit)
    total = city + 84183 + 15300 + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)
    label = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "RT managed forest ").otherwise("Residential RT ")
    row = F.concat(label, show(city), F.lit("  "), show(F.lit(84183)), F.lit("  "), show(F.lit(15300)), F.lit("  "), show(total))
    page = F.concat(F.lit("By-law schedule\n"), row, F.lit("\nFarmland 1.0 2.0\n"))
    rows = rates.rate_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), page.alias("page_text")), "page_text")
    # Declared decimal rates whose digits lie beyond the ninth place: they add up, miss by
    # more than the tolerance, or have more places than a rate can.
    kind = F.pmod("o_custkey", F.lit(3))
    total = F.when(kind == 1, "0.1234567903").when(kind == 2, "0.12345679010000000001").otherwise("0.1234567901")
    fine = F.concat(F.lit("RT 0.12345678912 0.00000000049 0.00000000049 "), total)
    declared = rates.rate_rows(table(spark, sf, "orders").select((-F.col("o_orderkey")).alias("code"), fine.alias("page_text")), "page_text", "decimal")
    both = rows.unionByName(declared)
    return both.select("code", F.floor(F.col("raw_city").cast("decimal(12,11)") * 100000).cast("bigint").alias("city"), "unit", "reason")


@query("table_row_extract", f"""
WITH l AS (
  SELECT l_orderkey AS code, l_linenumber AS line_no, CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) // 100 AS net, CAST(sum(round(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2
)
SELECT code, 'Service ' || CAST(line_no AS VARCHAR) AS label, net, net // 2 AS levy, a.area, q * a.k AS household
FROM l, (VALUES ('blended', 1), ('urban', 2), ('rural', 3), ('west', 4), ('mixed', 5)) AS a(area, k)
""")
def table_row_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Each order line prints one row of a wide table; the extractor reads the
    rows back and turns the areas into rows."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("line_no")).agg(
        F.expr("CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) div 100").alias("net"),
        F.sum(F.round("l_quantity").cast("bigint")).alias("q"),
    )
    whole = lambda c: F.format_number(c, 0)
    bare = F.col("line_no") % 2 == 1  # the published form has no percent signs, and dollar signs only on amounts
    areas = [F.concat(F.when(bare, "12.5 ").otherwise("12.5% "), F.lit("$"), whole(F.col("q") * k)) for k in (1, 2, 3, 4, 5)]
    levy = F.concat(F.when(bare, "").otherwise("$"), whole(F.expr("net div 2")))
    row = F.concat_ws(" ", F.concat(F.lit("Service "), F.col("line_no").cast("string"), F.lit(" (2)")), whole(F.col("net")), levy, *areas)
    return tables_on_pages.service_rows(lines.select("code", row.alias("row")), "row", ["blended", "urban", "rural", "west", "mixed"]).select(
        "code", "label", "net", "levy", "area", "household"
    )

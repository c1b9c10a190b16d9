"""Files, documents, archives, editions and the release stream."""

import datetime
import io
import json
import zipfile
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyroom.operators import projection
from tallyroom.operators.digests import record_digest, set_digest
from tallyroom.plans import QUERIES
from tallyroom.sources import adapters, archives, contracts, documents, editions, inventory, sinks
from tallyroom.streaming import intake


def zipped(members, compress=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", compress) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    good = "a,b\n" + "".join(f"{i},{i * i}\n" for i in range(50))
    (tmp_path / "good.zip").write_bytes(zipped({"m.csv": good}))
    (tmp_path / "again.zip").write_bytes(zipped({"m.csv": good}, zipfile.ZIP_STORED))
    (tmp_path / "extra.zip").write_bytes(zipped({"m.csv": good, "n.csv": "x"}))
    (tmp_path / "bomb.zip").write_bytes(zipped({"m.csv": "0" * 2_000_000}))
    (tmp_path / "junk.zip").write_bytes(b"not a zip")
    files = archives.read_archives(spark, str(tmp_path)).withColumn("member", F.lit("m.csv"))
    got = {r.path.rsplit("/", 1)[1]: r for r in archives.inspect_archives(files).collect()}
    assert {k: v.reason for k, v in got.items()} == {
        "good.zip": None, "again.zip": None, "extra.zip": "member set differs", "bomb.zip": "compression ratio too high", "junk.zip": "not an archive"}
    assert got["good.zip"].member_sha256 == got["again.zip"].member_sha256 and got["good.zip"].member_bytes == len(good)
    blocks = archives.member_blocks(files.filter(F.col("path").endswith("good.zip"))).collect()
    assert "\n".join(b.text for b in blocks) == good.rstrip("\n") and {b.reason for b in blocks} == {None}
    refused = {r.path.rsplit("/", 1)[1]: r.reason for r in archives.member_blocks(files).filter("reason IS NOT NULL").collect()}
    assert refused == {"extra.zip": "member set differs", "bomb.zip": "compression ratio too high", "junk.zip": "not an archive"}


def test_packed_members_stand_in_small_groups(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    texts = [f"{i} é " * 20_000 for i in range(60)] + [""]
    monkeypatch.setattr(archives, "PACKED_ROWS", 4, raising=False)
    names, column = pa.array([f"m{i}" for i in range(len(texts))]), pa.array(texts)
    tracemalloc.start()
    packed = archives.pack_member.func(names, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Python never holds the whole batch, only a group of its members.
    assert peak < sum(len(t.encode()) for t in texts) / 2
    for name, text, content in zip(names.to_pylist(), texts, packed.to_pylist()):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            assert archive.namelist() == [name] and archive.read(name).decode() == text
    assert archives.pack_member.func(names.slice(0, 0), column.slice(0, 0)).to_pylist() == []


def test_a_member_has_one_encoding(spark, monkeypatch):
    monkeypatch.setattr(archives, "BLOCK_BYTES", 8)
    mixed = "été\n".encode() * 5 + "é\n".encode("cp1252")
    data = spark.createDataFrame([("p", zipped({"m": mixed}), "m")], "path string, content binary, member string")
    text = "\n".join(b.text for b in sorted(archives.member_blocks(data, fallback="cp1252").collect(), key=lambda b: b.block))
    assert text == mixed.decode("cp1252").rstrip("\n")
    assert rows(archives.member_blocks(data), "block", "reason") == [(None, "text is not in the declared encoding")]


def test_unreadable_documents_carry_a_reason(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "broken"), (3, "{}"), (4, None)], "k int, d string")
    assert rows(documents.json_entries(df, "d"), "k", "json_key", "reason") == [
        (1, "a", None), (2, None, "not a JSON object"), (3, None, "no keys"), (4, None, "not a JSON object")]
    ledgers = documents.ledger_nodes(spark.createDataFrame([("broken",), ('{"facts":[{"id":"f"}]}',), ('{"id":"x"}',)], "d string"), "d")
    assert rows(ledgers, "ledger", "reason") == [(None, "no id"), (None, "not a JSON object"), ("x", "no nodes")]


@pytest.mark.parametrize("parts", [False, True])
def test_release_stream_reads_a_file_or_a_folder_of_parts(spark, tmp_path, parts):
    from tallyroom.plans import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    if parts:
        events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    else:
        (tmp_path / "events.parquet").symlink_to("/root/testdata/sf0.001/events.parquet")
    assert QUERIES["release_intake_stream"](spark, str(tmp_path)).agg(F.sum("records")).first()[0] == events.count()


def test_member_encoding(spark):
    data = spark.createDataFrame([("p", zipped({"m": "\ufeffcôté\nd".encode()}), "m"), ("q", zipped({"m": "côté".encode("cp1252")}), "m")], "path string, content binary, member string")
    got = dict(rows(archives.member_blocks(data, fallback="cp1252").groupBy("path").agg(F.concat_ws("|", F.collect_list("text")).alias("t")), "path", "t"))
    assert got["q"] == "côté" and got["p"].startswith("côté")


def test_pages(spark):
    df = spark.createDataFrame([("a", "x\n===== PAGE 3 =====\nthree\n=====PAGE  7=====seven"), ("b", "plain"), ("c", "===== PAGE 1 =====u===== PAGE 1 =====v")], "k string, t string")
    out = documents.split_pages(df, "k", "t")
    assert rows(out, "k", "page", "text", "repeated_page") == [
        ("a", 3, "\nthree\n", False), ("a", 7, "seven", False), ("b", 1, "plain", False), ("c", 1, "u", True), ("c", 1, "v", True)]


@pytest.mark.parametrize("cell,text,reason", [
    ('<a href="/x" title="Mattice-Val CÃ´tÃ©">Mattice-Val CÃ´tÃ©</a>', "Mattice-Val Côté", None),
    ('<a href="/x" title="A">B</a>', "B", "anchor text differs from its title"),
    ('<a href="/x" title="A">A</a><a href="/y" title="A">A</a>', "A", "not exactly one anchor"),
    ("Plain", "", "not exactly one anchor"),
    ('<a href="/x" title=""></a>', "", "anchor has no text"),
])
def test_link_cells(spark, cell, text, reason):
    t, h, r = documents.link_cell(F.col("c"))
    assert rows(spark.createDataFrame([(cell,)], "c string").select(t.alias("t"), r.alias("r")), "t", "r") == [(text, reason)]


def test_ledger_arrays(spark):
    doc = {"id": "L", "sources": [{"id": "s1"}, {"id": "s2"}], "facts": [{"id": "f1", "sourceId": "s1", "page": 2, "amountCad": 5.25}], "findings": [{"id": "x", "cited": ["f1"]}]}
    out = documents.ledger_nodes(spark.createDataFrame([(json.dumps(doc),)], "d string"), "d")
    assert rows(out, "kind", "position", "node_id") == [("facts", 0, "f1"), ("findings", 0, "x"), ("sources", 0, "s1"), ("sources", 1, "s2")]


def test_csv_rules(spark):
    lines = ['1,2023,"a, b"', "2,2023,b,more", "3,2023", " ,2023,c", "5,2022,d", '6,2023,"say ""hi"", x",y,z']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    out = contracts.csv_verdicts(df, "line", ["id", "year", "name"], "id", "year", 2023, max_extra=1)
    assert rows(out, "record_id", "name", "reason") == [
        ("", "c", "invalid record id"), ("1", "a, b", None), ("2", "b", None), ("3", None, "missing columns"),
        ("5", "d", "another fiscal year"), ("6", 'say "hi", x', "unreviewed extra columns")]


def test_contract_reports_drift(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    out = contracts.contract_report(df, "t", {"a": "int", "b": "string", "c": "date"})
    assert rows(out, "column_name", "status", "null_rows") == [("a", "changed", 0), ("b", "ok", 1), ("c", "missing", None)]


def test_schema_queries_see_whole_tables(spark, tmp_path):
    given = Path("/root/testdata/sf0.001")
    for f in given.iterdir():
        (tmp_path / f.name).symlink_to(f)
    (tmp_path / "region.parquet").unlink()
    spark.read.parquet(f"{given}/region.parquet").selectExpr("cast(r_regionkey as string) AS r_regionkey", "1 AS added").write.parquet(f"{tmp_path}/region.parquet")
    found = {name: {(r.table_name, r.column_name): r.status for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("schema_contract", "schema_drift")}
    for report in found.values():
        assert (report["region", "r_regionkey"], report["region", "r_name"]) == ("changed", "missing")
    drift = found["schema_drift"]
    assert {k for k, v in drift.items() if v == "extra"} == {("region", "added"), ("labels", "toxic"), ("supplier", "s_acctbal")}
    assert drift["nation", "n_comment"] == "missing" and drift["nation", "n_regionkey"] == "changed"
    assert {drift[c] for c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"), ("embeddings", "embedding"))} == {"ok"}


REMARK = "Now part of (dissolution) - Maintenant partie de (dissolution) - Chapple , TP"


def test_editions(spark, tmp_path):
    (tmp_path / "old.csv").write_text(
        f'Barwick,,TP,4,01/01/2010,35 51 024,,"{REMARK}"\nBarwick,,TP,1,01/01/2010,35 51 025,,x\nOdd,,NO,4,31/02/2010,35 51 026,,no remark\n', encoding="cp1252")
    (tmp_path / "new.csv").write_text(
        ",Chapple,TP,,,3551024,Barwick,TP,4,01/01/2010,\n,X,TP,,,2451024,Elsewhere,TP,4,01/01/2010,\n,Chapple,TP,,,3559999,Réserve,S-É,4,02/03/2012,\n", encoding="cp1252")
    old, new = editions.read_edition(spark, str(tmp_path / "old.csv"), 8), editions.read_edition(spark, str(tmp_path / "new.csv"), 11)
    events = editions.union_editions({"old": (old, editions.legacy_events), "new": (new, lambda r, s: editions.gaining_losing_events(r, s, 8, 9))})
    assert rows(events, "source_id", "source_line", "dissolved", "successor", "levied", "sgc_code", "reason") == [
        ("new", 1, "Barwick", "Chapple", True, "3551024", None), ("new", 3, "Réserve", "Chapple", False, "3559999", None),
        ("old", 1, "Barwick", "Chapple", True, "3551024", None), ("old", 3, "Odd", None, False, "3551026", "no parseable successor")]
    good = events.filter("reason IS NULL")
    kept = editions.dedupe_events(good, ["old", "new"])
    assert rows(kept, "sgc_code", "source_id", "copies", "status") == [("3551024", "old", 2, "accepted"), ("3559999", "new", 1, "accepted")]
    clash = good.withColumn("successor", F.when(F.col("source_id") == "new", "Other").otherwise(F.col("successor")))
    assert rows(editions.dedupe_events(clash, ["old", "new"]), "sgc_code", "status") == [("3551024", "conflict"), ("3559999", "accepted")]


def test_adapters(spark):
    good = json.dumps({"records": [{"id": "1", "name": "A"}, {"id": "2", "name": "B", "owner": "x"}]}).encode()
    payloads = spark.createDataFrame([("j", "json-directory", good), ("c", "csv-directory", "id,name\n7,Côté\n8\n".encode("cp1252")), ("n", "pdf", b"")], "source_id string, adapter string, payload binary")
    assert rows(adapters.parse_payloads(payloads), "source_id", "record_id", "name", "reason") == [
        ("c", "7", "Côté", None), ("c", "8", None, "wrong number of cells"), ("j", "1", "A", None), ("j", "2", "B", "unknown field owner"), ("n", None, None, "no adapter")]


def test_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("b")
    found = inventory.read_inventory(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    manifest = spark.createDataFrame([("a.txt", 1, "0" * 64), ("c.txt", 1, "x")], "path string, bytes long, sha256 string")
    assert rows(inventory.inventory_diff(found, manifest, ["bytes", "sha256"]), "path", "status", "differs") == [
        ("a.txt", "changed", "sha256"), ("b.txt", "unlisted", ""), ("c.txt", "missing", "")]


def test_classification(spark, tmp_path):
    from tallyroom.sources.registry_files import read_classification

    path = tmp_path / "c.csv"
    path.write_text('Level,Hierarchical structure,Code,Class title\n1,Region,3,Ontario\n2,Province,35,Ontario\n3,Division,3518,"Durham, R"\n4,Subdivision,3518013,Oshawa\n3,Division,36,Odd\n9,x,123,Bad\n')
    assert rows(read_classification(spark, str(path)), "code", "level", "parent_code", "reason") == [
        ("123", None, None, "code has no level"), ("3", "region", None, None), ("35", "province-territory", "3", None),
        ("3518", "census-division", "35", None), ("3518013", "census-subdivision", "3518", None), ("36", "province-territory", "3", "level does not fit the code")]


def test_governing_bodies(spark):
    from tallyroom.operators.gates import duplicate_keys
    from tallyroom.sources.registry_files import external_ids, governing_bodies

    good = {"id": "on-0001", "body_type": "municipal-government", "official_names": {"en": "A", "fr": "A"}, "url": "https://a.example", "external_ids": {"sgc": "1"},
            "geography_ids": ["g1"], "effective_from": "2001-01-01"}
    bad = {**good, "id": "On 2", "owner": "x", "url": "http://b", "geography_ids": ["g", "g"], "effective_to": "2000-01-01"}
    out = governing_bodies(spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "d string"), "d")
    assert {r.id: r.violations for r in out.collect()} == {
        "on-0001": [], "On 2": ["unknown-field", "id", "url", "repeated-geography", "end-before-start"]}
    assert rows(duplicate_keys(external_ids(out), ["scheme", "value"]), "scheme", "value", "copies") == [("sgc", "1", 2)]


def test_receipts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2023, "0001", 5), (2024, "0001", 6)], "fiscal_year int, code string, grand long")
    docs = sinks.receipt_documents(df.withColumn("y", F.col("fiscal_year")), "code", ["fiscal_year", "grand"])
    sinks.write_receipts(docs, str(tmp_path / "out"))
    back = spark.read.schema("code string, grand long, document string, digest string, fiscal_year int").parquet(str(tmp_path / "out"))
    assert rows(back.filter("fiscal_year = 2024"), "code", "grand") == [("0001", 6)]
    assert json.loads(back.filter("fiscal_year = 2023").collect()[0].document) == {"code": "0001", "fiscal_year": 2023, "grand": 5}
    assert rows(sinks.receipt_index(docs, "code"), "path") == [("by-code/0001.json",)] * 2


def test_a_failed_publication_leaves_the_last_version(spark, tmp_path):
    root = str(tmp_path / "out")
    docs = lambda *pairs: sinks.receipt_documents(spark.createDataFrame(list(pairs), "code string, grand int"), "code", ["grand"])
    with pytest.raises(LookupError):
        sinks.published(spark, root)
    assert sinks.publish(docs(("a", 1), ("b", 2), ("c", 3)), root, "code") == 1
    with pytest.raises(ValueError, match="2 documents have 1 keys"):
        sinks.publish(docs(("a", 8), ("a", 9)), root, "code")
    broken = docs(("a", 7)).withColumn("document", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, root, "code")
    now = docs(("a", 1), ("b", 5), ("d", 4))
    assert rows(sinks.freshness(now, root, "code"), "code", "status") == [("a", "fresh"), ("b", "changed"), ("c", "stale"), ("d", "missing")]
    assert sinks.publish(now, root, "code") == 2
    assert rows(sinks.published(spark, root, "documents"), "code", "grand") == [("a", 1), ("b", 5), ("d", 4)]
    assert rows(sinks.published(spark, root, "documents", 1), "code", "grand") == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(sinks.commits(spark, root), "version", "records") == [(1, 3), (2, 3)]
    assert sinks.publish(now.limit(0), root, "code") == 3 and sinks.published(spark, root).count() == 0


def test_digests(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "a"), (2, "a")], "g int, v string")
    digests = df.withColumn("d", record_digest("v"))
    assert digests.select("d").distinct().count() == 2
    one = {r.g: (r.records, r.set_digest) for r in set_digest(digests, ["g"], "d").collect()}
    other = {r.g: (r.records, r.set_digest) for r in set_digest(digests.orderBy(F.desc("v")).repartition(3), ["g"], "d").collect()}
    assert one == other and one[1][0] == 3 and one[1][1] != one[2][1]


def test_denied_keys(spark):
    docs = [(1, '{"a": {"User-ID": 1, "x": "not \\"email\\": here"}}'), (2, '[{"eMail" : null}]'), (3, '{"k": "email"}')]
    out = projection.denied_keys(spark.createDataFrame(docs, "id int, d string"), "d", ["userid", "email"])
    assert rows(out, "id", "found_key") == [(1, "User-ID"), (2, "eMail")]
    schema = spark.createDataFrame([], "a struct<user_id: int, b: array<struct<eMail: string>>>, c map<string, struct<email: int>>").schema
    assert projection.denied_columns(schema, ["userid", "email"]) == ["$.a.user_id", "$.a.b[].eMail", "$.c{}.email"]


def test_release_stream_takes_each_record_once(spark, tmp_path):
    source, folder = tmp_path / "landing", str(tmp_path / "run")
    schema = "id long, v string"
    lock = spark.createDataFrame([(1, "a"), (2, "b")], schema).select("id", record_digest("v").alias("digest"))

    def drop(*records):
        spark.createDataFrame(list(records), schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        target = intake.run_intake(stream, lock, "id", ["v"], folder)
        return rows(intake.taken(spark, target), "id", "v", "status")

    drop((1, "a"), (2, "changed"), (3, "new"))
    first = run()
    assert first == [(1, "a", "accepted"), (2, "changed", "quarantined"), (3, "new", "late")]
    drop((1, "a"), (4, "later"))  # the same record in another file adds nothing
    assert run() == [*first, (4, "later", "late")]
    assert run() == [*first, (4, "later", "late")]


def test_dates_and_offsets(spark):
    from tallyroom.functions import text

    df = spark.createDataFrame([("20240229", "29/02/2024", "2024-02-29T10:00:00Z"), ("20230229", "29/02/2023", "2024-02-29T10:00:00"), ("2024-2-9", "1-2-2024", "2024-02-29T10:00:00+05:30")], "a string, b string, c string")
    got = df.select(text.compact_date(F.col("a")).alias("a"), text.slash_date(F.col("b")).alias("b"), text.offset_timestamp(F.col("c")).isNotNull().alias("c"))
    assert rows(got, "a", "b", "c") == [(None, None, False), (None, None, True), (datetime.date(2024, 2, 29), datetime.date(2024, 2, 29), True)]


def test_encoding_policies(spark, tmp_path):
    from tallyroom.sources.encodings import read_lines

    (tmp_path / "u.txt").write_bytes("\ufeffcôté €, \"q\nx\r\n".encode())
    (tmp_path / "w.txt").write_bytes("côté €\nplain\n".encode("cp1252"))
    read = lambda name, policy: rows(read_lines(spark, str(tmp_path / name), policy), "text", "reason")
    assert read("u.txt", "utf-8") == [("côté €, \"q", None), ("x", None)] or read("u.txt", "utf-8") == [("x", None), ("côté €, \"q", None)]
    assert read("w.txt", "utf-8") == [(None, "not valid UTF-8"), ("plain", None)]
    assert read("w.txt", "cp1252") == [("côté €", None), ("plain", None)]
    assert {t for t, _ in read("w.txt", "utf-8-or-cp1252")} == {"côté €", "plain"}
    assert {t for t, _ in read("u.txt", "utf-8-or-cp1252")} == {"côté €, \"q", "x"}


def test_preamble(spark):
    df = spark.createDataFrame([(1, "Title"), (2, "note"), (3, "id,name"), (4, "1,a")], "n int, line string")
    assert rows(contracts.drop_preamble(df, "n", 2), "line") == [("1,a",)]


def test_line_numbers_of_split_and_packed_files(spark, tmp_path):
    from tallyroom.sources.lines import numbered_lines

    (tmp_path / "big.txt").write_text("".join(f"row {i}\n" if i % 9 else "\n" for i in range(1, 4001)))
    for k in range(12):
        (tmp_path / f"small{k:02}.txt").write_bytes(f"a{k}\r\n\r\ncôté\n".encode("cp1252"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        lines = numbered_lines(spark, str(tmp_path), windows=True)
        assert lines.rdd.getNumPartitions() > 1
        got = {}
        for r in lines.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], {})[r.line_no] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.pop("big.txt") == {i: f"row {i}" if i % 9 else "" for i in range(1, 4001)}
    assert got == {f"small{k:02}.txt": {1: f"a{k}", 2: "", 3: "côté"} for k in range(12)}


def test_many_small_editions_keep_their_line_numbers(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"e{k:02}.csv").write_text(f"x{k},1\ny,2\nz,3\n", encoding="cp1252")
    got = editions.read_edition(spark, str(tmp_path), 2).collect()
    assert len(got) == 60 and {(r.line_no, r.c1) for r in got} == {(1, "1"), (2, "2"), (3, "3")}


def test_json_records_keep_their_types(spark):
    docs = [
        (1, '{"r": [{"id": 1, "name": "[sic] Town"}, {"id": "2", "name": null}, {"id": "3", "name": true}, {"id": " 4 ", "name": " {x "}, 7, {"id": "5", "name": {"a": 1}}]}'),
        (2, "not json"), (3, '{"r": null}'), (4, '{"q": []}'), (5, '{"r": []}'), (6, '{"r": "[1]"}'), (7, "[1]"), (8, None), (9, '{"r": [{"name": "no key"}]}'),
    ]
    out = documents.json_records(spark.createDataFrame(docs, "d int, t string"), "t", "r", "id", ["id", "name"])
    got = {(r.d, r.position): (r.id, r.name, r.reason) for r in out.collect()}
    assert got == {
        (1, 0): ("1", "[sic] Town", None), (1, 1): ("2", None, "record holds a null"), (1, 2): ("3", "True", None), (1, 3): ("4", "{x", None),
        (1, 4): (None, None, "record is not an object"), (1, 5): ("5", '{"a":1}', "record holds a list or an object"), (2, None): (None, None, "not a JSON object"),
        (3, None): (None, None, "not an array"), (4, None): (None, None, "no collection at the path"), (5, None): (None, None, "empty collection"),
        (6, None): (None, None, "not an array"), (7, None): (None, None, "no collection at the path"), (8, None): (None, None, "not a JSON object"),
        (9, 0): (None, "no key", "record has no key"),
    }
    whole = documents.json_records(spark.createDataFrame([('[{"id": "a"}, {"id": "a"}]',)], "t string"), "t", "$", "id", ["id"])
    assert rows(whole, "position", "id", "reason") == [(0, "a", "key is repeated"), (1, "a", "key is repeated")]


def test_csv_records(spark):
    texts = [(1, 'id,name\n1,"a, b"\n\n2\n ,x\n3, c ,more'), (2, "code\n1"), (3, "id\n"), (4, ",".join(f"c{i}" for i in range(5)) + "\n1"), (5, "\ufeffid\r\n7\r\n7")]
    out = documents.csv_records(spark.createDataFrame(texts, "d int, t string"), "t", "id", ["id", "name"], width=4)
    assert rows(out, "d", "position", "id", "name", "reason") == [
        (1, 0, "1", "a, b", None), (1, 1, "2", "", None), (1, 2, "", "x", "record has no key"), (1, 3, "3", "c", None),
        (2, None, None, None, "key is absent from the header"), (3, None, None, None, "empty collection"), (4, None, None, None, "too many columns"),
        (5, 0, "7", None, "key is repeated"), (5, 1, "7", None, "key is repeated")]


def test_unreadable_payloads_are_refused_alone(spark):
    payloads = spark.createDataFrame(
        [("a", "json-directory", b"{"), ("b", "json-directory", b"[]"), ("c", "json-directory", b'{"records": [1]}'), ("d", "json-directory", b"\xff"), ("e", "csv-directory", None), ("f", "csv-directory", b"id,name\n1,A\n")],
        "source_id string, adapter string, payload binary")
    got = {r.source_id: (r.record_id, r.reason) for r in adapters.parse_payloads(payloads).collect()}
    assert got.pop("f") == ("1", None)
    assert all(reason.startswith("unreadable payload") for _, reason in got.values()) and set(got) == set("abcde")


def test_stream_reads_only_what_landed(spark, tmp_path):
    schema = "id long, v string"
    source, folder = tmp_path / "landing", str(tmp_path / "run")
    lock = spark.createDataFrame([(1, "a")], schema).select("id", record_digest("v").alias("digest"))

    def run(*records):
        spark.createDataFrame(list(records), schema).coalesce(1).write.mode("append").parquet(str(source))
        return intake.run_intake(spark.readStream.schema(schema).parquet(str(source)), lock, "id", ["v"], folder)

    target = run((1, "a"), (2, "b"))
    for old in Path(target).glob("epoch=0/*.parquet"):
        old.unlink()  # an earlier epoch is not needed to know what was taken
    run((1, "a"), (2, "b"), (2, "c"))
    assert [(r.id, r.v) for r in spark.read.schema(schema).parquet(f"{target}/epoch=1").collect()] == [(2, "c")]

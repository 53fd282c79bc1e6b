import glob
import json
import os

from pyspark.sql import functions as F

from bazaar.contract import RAW_COLUMNS, raw_schema, to_snake
from bazaar.sources.raw import read_csv, read_landed, read_rejected
from bazaar.sources.workspace import new_folder
from bazaar.streaming.land import land_and_wait
from bazaar.streaming.messages import all_messages, from_messages, read_kafka, read_message_files, rejected, send_kafka, to_messages


def test_csv_header_quotes_and_bytes(spark, tmp_path):
    """Byte order mark, quoted comma, doubled quote, line break in quotes, bad byte, empty field, columns out of order."""
    lines = ["\ufeffStore ID,Employee ID,Position,Name", '1,10,,"A, ""B""\nC"', "2,20, Seller ,Zoë", "3,30,x,Y"]
    path = tmp_path / "employees.csv"
    path.write_bytes("\r\n".join(lines).encode() + b"\xff\r\n")
    rows = {r["Employee ID"]: r for r in read_csv(spark, str(path), "employees", multiline=True).collect()}
    assert rows["10"]["Name"] == 'A, "B"\nC' and rows["10"]["Position"] == "" and rows["10"]["Store ID"] == "1"
    assert rows["20"]["Name"] == "Zoë" and rows["20"]["Position"] == " Seller "
    assert rows["30"]["Name"] == "Y�"


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    path = tmp_path / "employees.csv"
    path.write_text("﻿Employee ID,Store ID,Name,Position\n1,2,a,b\n", encoding="utf-8")
    assert read_csv(spark, str(path), "employees").first()["Employee ID"] == "1"


def test_messages_keep_empty_fields_and_other_alphabets(spark):
    rows = spark.createDataFrame([("1", None, "Zoë 王", "")], raw_schema("employees"))
    message = to_messages(rows, "employees").first()
    assert message.topic == "employees"
    assert message.value == '{"Employee ID":"1","Store ID":null,"Name":"Zoë 王","Position":""}'
    back = from_messages(to_messages(rows, "employees"), "employees")
    assert back.columns == list(RAW_COLUMNS["employees"]) and tuple(back.first()) == ("1", None, "Zoë 王", "")


def test_undecodable_messages_are_set_aside(spark):
    values = ['{"Employee ID":"1"}', '{"Employee ID":"1"} {"Employee ID":"2"}', '{"Employee ID":"1"}, {"Employee ID":"2"}', '{"Employee ID":"1"}xx', "not json", "[1]", '{"Employee ID":', "", None, "7", "null"]
    messages = spark.createDataFrame([("employees", v) for v in values], "topic string, value string")
    assert from_messages(messages, "employees").count() == 1
    assert rejected(messages).count() == len(values) - 1


def test_numbers_in_messages_stay_text(spark):
    messages = spark.createDataFrame([("employees", '{"Employee ID":12.5,"Name":true}')], "topic string, value string")
    row = from_messages(messages, "employees").first()
    assert (row["Employee ID"], row["Name"]) == ("12.5", "true")


def test_landing_is_exactly_once(spark):
    source, raw, checkpoint = (new_folder(spark, n) for n in ("messages", "raw", "stream"))
    employees = spark.range(500).select(
        *(F.col("id").cast("string").alias(c) for c in RAW_COLUMNS["employees"])
    )
    to_messages(employees, "employees").write.mode("append").parquet(source)

    def landed():
        return read_landed(spark, raw, "employees").count()

    land_and_wait(read_message_files(spark, source), raw, checkpoint)
    assert landed() == 500
    land_and_wait(read_message_files(spark, source), raw, checkpoint)
    assert landed() == 500

    more = spark.createDataFrame(
        [("employees", json.dumps({"Employee ID": "900", "Position": "a\nb"}, indent=2)), ("employees", "broken")],
        "topic string, value string",
    )
    more.write.mode("append").parquet(source)
    land_and_wait(read_message_files(spark, source), raw, checkpoint)
    assert landed() == 501
    assert [tuple(r) for r in read_rejected(spark, raw).collect()] == [("employees", "broken")]
    stray = f"{raw}/status=ok/topic=employees/part-of-a-lost-task.txt"
    with open(stray, "w") as f:
        f.write('{"Employee ID":"1"}\n')
    assert landed() == 501
    assert read_landed(spark, raw, "stores").count() == 0
    spread_over_lines = read_landed(spark, raw, "employees").filter("employee_id = '900'").first()
    assert spread_over_lines.name is None and spread_over_lines.position == "a\nb"


def test_landed_lines_take_less_room_than_their_text(spark):
    """Names of fields are in every line: uncompressed, the raw zone is several times the rows it holds."""
    source, raw, checkpoint = (new_folder(spark, n) for n in ("messages", "raw", "stream"))
    rows = spark.range(20_000).select(*(F.col("id").cast("string").alias(c) for c in RAW_COLUMNS["transactions"]))
    messages = to_messages(rows, "transactions")
    messages.write.parquet(source)
    text = messages.agg(F.sum(F.octet_length("value") + 1)).first()[0]
    land_and_wait(read_message_files(spark, source), raw, checkpoint)
    files = glob.glob(f"{raw}/status=ok/topic=transactions/part-*")
    assert 0 < sum(os.path.getsize(f) for f in files) < text / 3
    assert read_landed(spark, raw, "transactions").exceptAll(to_snake(rows)).count() == 0
    assert read_landed(spark, raw, "transactions").count() == 20_000


def test_one_topic_per_table(spark):
    from bazaar.sources.adapter import raw_tables
    from tests.conftest import SF_DIR

    topics = all_messages(raw_tables(spark, SF_DIR)).select("topic").distinct().collect()
    assert {t.topic for t in topics} == set(RAW_COLUMNS)


def test_a_message_is_parsed_once(spark):
    messages = spark.createDataFrame([("employees", '{"Name":"a"}')], "topic string, value string")
    for df in (from_messages(messages, "employees"), from_messages(messages, "employees").filter("Name is not null"), rejected(messages)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_a_topic_reads_its_own_folder(spark):
    source, raw, checkpoint = (new_folder(spark, n) for n in ("messages", "raw", "stream"))
    spark.createDataFrame([(t, "{}") for t in RAW_COLUMNS], "topic string, value string").write.parquet(source)
    land_and_wait(read_message_files(spark, source), raw, checkpoint)
    plan = read_landed(spark, raw, "stores")._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "status" in partition_filters and "topic" in partition_filters


class Recorder:
    """Stands for the reader or writer of a connector that is not installed here."""

    def __init__(self):
        self.said = {}

    readStream = property(lambda self: self)
    write = property(lambda self: self)

    def format(self, name):
        self.said["format"] = name
        return self

    def option(self, key, value):
        self.said[key] = value
        return self

    def load(self):
        return self

    save = load

    def select(self, *columns):
        self.said["columns"] = len(columns)
        return self


def test_kafka_options(spark):
    stream = read_kafka(Recorder(), "a:1,b:2", per_trigger=5)
    assert stream.said == {
        "format": "kafka", "kafka.bootstrap.servers": "a:1,b:2", "subscribe": "customers,products,stores,employees,discounts,transactions",
        "startingOffsets": "earliest", "maxOffsetsPerTrigger": 5, "columns": 2,
    }
    sent = Recorder()
    send_kafka(sent, "a:1")
    assert sent.said == {"format": "kafka", "kafka.bootstrap.servers": "a:1"}

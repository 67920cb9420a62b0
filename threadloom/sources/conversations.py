"""Conversation, question and record files as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.ingest import session_number

TURN = "array<struct<speaker:string,text:string,img_url:string,query:string,blip_caption:string>>"
QUESTION = "question string, answer string, adversarial_answer string, evidence array<string>, category int"
USER = (
    "uuid string, persona_info string, sessions array<struct<dialogue:array<struct<timestamp:string,role:string,content:string>>,"
    "memory_points:array<struct<memory_content:string,is_update:string,original_memories:array<string>>>,"
    "questions:array<struct<question:string>>,is_generated_qa_session:boolean>>"
)


def read_conversations(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """A JSON object a file (``whole``) or a line: name, session, session_time, turn and the turn's fields.

    Sessions are the keys ``session_N``, in order of N; what does not parse has null fields and is kept apart by
    its null session.
    """
    raw = spark.read.text(path, wholetext=whole).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1).alias("file"), F.col("value"))
    fields = raw.select("file", F.from_json("value", "map<string,string>").alias("m"))
    name = F.coalesce(F.element_at("m", "name"), F.regexp_replace("file", "^[a-z]+_(?=conv)", ""))
    keyed = fields.select(name.alias("name"), "m", F.explode_outer("m").alias("key", "value"))
    sessions = keyed.withColumn("session", session_number(F.col("key"))).where("session is not null or m is null")
    time = F.element_at("m", F.concat("key", F.lit("_date_time")))
    return sessions.select("name", "session", time.alias("session_time"), F.posexplode_outer(F.from_json("value", TURN)).alias("turn", "t")).select("name", "session", "session_time", "turn", "t.*")


def write_conversations(turns: DataFrame, path: str) -> None:
    """One JSON object a line for each dialog of (name, session, turn, speaker, text)."""
    sessions = turns.groupBy("name", "session").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("t"))
    plain = F.to_json(F.transform("t", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))))
    field = F.concat(F.lit('"session_'), F.col("session").cast("string"), F.lit('":'), plain)
    whole = sessions.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("session", field.alias("f")))).alias("all"))
    line = F.concat(F.lit('{"name":"'), F.col("name"), F.lit('",'), F.array_join(F.transform("all", lambda x: x["f"]), ","), F.lit("}"))
    whole.select(line.alias("value")).write.text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """S3: questions; the adversarial answer counts where there is one."""
    return spark.read.schema(QUESTION).json(path, multiLine=True).withColumn("gold", F.coalesce("adversarial_answer", "answer"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """One user a line, blank lines skipped."""
    return spark.read.schema(USER).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registered sessions with their files and sizes."""
    one = spark.read.schema("sessions array<struct<conv_id:string,conv_json:string,qa_json:string,num_messages:int>>").json(path, multiLine=True)
    return one.select(F.explode("sessions").alias("s")).select("s.*")


def append_records(rows: DataFrame, path: str) -> None:
    """Telemetry as JSON lines, added to what is there."""
    rows.write.mode("append").json(path)

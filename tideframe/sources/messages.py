"""The binary message protocol: the first byte is the kind, the rest the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

SERVER_INFO = T.StructType(
    [
        T.StructField("text_temperature", T.DoubleType()),
        T.StructField("text_topk", T.DoubleType()),
        T.StructField("audio_temperature", T.DoubleType()),
        T.StructField("audio_topk", T.DoubleType()),
        T.StructField("pad_mult", T.DoubleType()),
        T.StructField("repetition_penalty_context", T.DoubleType()),
        T.StructField("repetition_penalty", T.DoubleType()),
        T.StructField("lm_model_file", T.StringType()),
        T.StructField("instance_name", T.StringType()),
        T.StructField("build_info", T.MapType(T.StringType(), T.StringType())),
    ]
)
ADD_USER = T.StructType([T.StructField("session_id", T.DoubleType()), T.StructField("session_auth_id", T.StringType())])
CHECK_USER = T.StructType(
    [
        T.StructField("session_id", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("worker_auth_id", T.StringType()),
        T.StructField("worker_addr", T.StringType()),
        T.StructField("current_position", T.StringType()),
    ]
)


def _byte(n: int) -> Column:
    return F.unhex(F.lit(f"{n:02X}"))


def action_number(action: Column) -> Column:
    out = F.lit(None).cast("binary")
    for n, name in enumerate(C.ACTIONS):
        out = F.when(action == name, _byte(n)).otherwise(out)
    return out


def encode(kind: Column, data: Column) -> Column:
    """Message bytes of a kind's name and its data as text (an action for control, JSON for metadata)."""
    text = F.encode(data, "UTF-8")
    out = F.lit(None).cast("binary")
    bodies = {"handshake": F.unhex(F.lit("0000")), "control": action_number(data), "ping": F.unhex(F.lit(""))}
    for n, name in enumerate(C.KINDS):
        out = F.when(kind == name, F.concat(_byte(n), bodies.get(name, text))).otherwise(out)
    return out


def decode(message: Column) -> Column:
    """A struct (type, data, error). Unknown kinds and actions, and empty messages, are errors rather than rows lost."""
    kind = F.conv(F.hex(F.substring(message, 1, 1)), 16, 10).cast("int")
    rest = F.substring(message, 2, 2**31 - 1)
    names = F.array(*[F.lit(k) for k in C.KINDS])
    name = F.when(kind < len(C.KINDS), F.get(names, kind))
    action = F.get(F.array(*[F.lit(a) for a in C.ACTIONS]), F.conv(F.hex(F.substring(rest, 1, 1)), 16, 10).cast("int"))
    data = F.when(name == "control", action).when(name.isin("text", "metadata", "error"), F.decode(rest, "UTF-8")).when(name == "audio", F.hex(rest))
    error = F.when(F.length(message) == 0, "empty message").when(name.isNull(), "unknown kind").when((name == "control") & action.isNull(), "unknown action")
    return F.struct(name.alias("type"), data.alias("data"), error.alias("error"))


def valid_messages(raw: DataFrame, column: str = "message") -> tuple[DataFrame, DataFrame]:
    """Decoded messages, and those that are dropped with the reason."""
    rows = raw.withColumn("_m", decode(F.col(column)))
    fine = rows.where(F.col("_m.error").isNull()).select("*", "_m.type", "_m.data").drop("_m")
    bad = rows.where(F.col("_m.error").isNotNull()).select("*", F.col("_m.error").alias("error")).drop("_m")
    return fine, bad


def audio_message(payload: Column) -> Column:
    return F.concat(_byte(1), payload)


def text_message(text: Column) -> Column:
    return F.concat(_byte(2), F.encode(text, "UTF-8"))


def handshake() -> Column:
    return _byte(0)


def checked_json(text: Column, schema: T.StructType, optional: tuple[str, ...] = ()) -> Column:
    """The struct, or null if the JSON does not hold every field that is not optional."""
    parsed = F.from_json(text, schema)
    needed = None
    for f in schema.fields:
        if f.name not in optional:
            here = parsed[f.name].isNotNull()
            needed = here if needed is None else needed & here
    return F.when(needed, parsed) if needed is not None else parsed


def server_info(text: Column) -> Column:
    return checked_json(text, SERVER_INFO)


def add_user(text: Column) -> Column:
    return checked_json(text, ADD_USER)


def check_user(text: Column) -> Column:
    parsed = checked_json(text, CHECK_USER, ("worker_auth_id", "worker_addr"))
    return F.when(parsed["status"].isin("wait", "ready"), parsed)

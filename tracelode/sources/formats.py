"""Readers of raw operational logs into canonical events (entity_id, timestamp, event_type, event_subtype), and sinks.

Every reader states its schema, so that no pass over the data infers one, and filters before it projects."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.features import surprises
from tracelode.operators.ordered import ranked

#: The closed vocabulary of event types.
VOCABULARY = {
    "machines": ["software_error", "maintenance", "component_replacement", "terminal_failure"],
    "tasks": ["task_failure", "task_success", "task_waiting", "task_running"],
    "log": ["terminal_alert", "system_error", "system_warning", "system_info"],
    "turbines": ["system_warning", "system_stop", "system_info", "system_comm", "terminal_failure"],
    "counters": ["counter_surprise", "terminal_repair"],
}


def strangers(events: DataFrame, source: str) -> DataFrame:
    """The event types of normalised events, with their counts, that the source's closed vocabulary doesn't have."""
    return events.groupBy("event_type").agg(F.count("*").alias("n")).where(F.col("event_type").isNull() | ~F.col("event_type").isin(VOCABULARY[source]))


def machine_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Five CSV files with headers: telemetry, errors, maintenance, failures, machines. A missing one raises."""
    schemas = {
        "telemetry": "datetime timestamp, machineID int, volt double, rotate double, pressure double, vibration double",
        "errors": "datetime timestamp, machineID int, errorID string",
        "maint": "datetime timestamp, machineID int, comp string",
        "failures": "datetime timestamp, machineID int, failure string",
        "machines": "machineID int, model string, age int",
    }
    return {k: spark.read.schema(v).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/PdM_{k}.csv") for k, v in schemas.items()}


def batch_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A CSV without header and with nine named columns."""
    schema = "task_name string, instance_num long, job_name string, task_type string, status string, start_time long, end_time long, plan_cpu double, plan_mem double"
    return spark.read.schema(schema).csv(path)


def system_log(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated log lines in ten parts, the last with all that is left; malformed is true where a line has
    fewer than nine, no whole number as time, or no rack as node."""
    parts = F.split(F.col("value"), " ", 10)
    names = ["label", "unix_ts", "date", "node", "iso_ts", "node2", "component_kind", "component", "severity", "message"]
    rows = spark.read.text(path).select("value", *[F.get(parts, i).alias(n) for i, n in enumerate(names)], F.size(parts).alias("n_parts"))
    seconds = F.when(F.col("unix_ts").rlike(r"^-?\d{1,18}$"), F.col("unix_ts").cast("long"))
    rack = F.nullif(F.regexp_extract("node", r"^(R\d+)", 1), F.lit(""))
    bad = (F.col("n_parts") < 9) | seconds.isNull() | rack.isNull()
    return rows.select("*", seconds.alias("seconds"), rack.alias("rack"), bad.alias("malformed"))


def headed(spark: SparkSession, path: str, required: list[str], wanted: list[str], sep: str = ",", strict: bool = True) -> DataFrame:
    """file and the wanted columns (as text) of delimited files of which each has its own header, in any order and behind
    any preamble: the first line that names all required columns. Columns that a file doesn't have are null in its rows.

    Files are read by line, so that large ones are split. A line is data where it comes behind its file's header; it is
    cut by a reader of text columns, of which each file's header tells the places. A file without header is an error
    that names it; where not strict it is left out, and `headless` lists it."""
    lines, heads = header_lines(spark, path, required, sep)
    if strict and (bad := [r.file for r in headless(spark, path, required, sep).orderBy("file").limit(5).collect()]):
        raise ValueError(f"no header with {', '.join(required)} in {', '.join(bad)}")
    width = heads.agg(F.max(F.size("names"))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    behind = (F.col("block") > F.col("head.block")) | ((F.col("block") == F.col("head.block")) & (F.col("at") > F.col("head.at")))
    rows = lines.join(heads, "file").where(behind & (F.trim("value") != ""))
    cells = rows.select("file", "names", F.from_csv("value", schema, {"sep": sep}).alias("r")).select("file", "names", F.array(*[f"r.c{i}" for i in range(width)]).alias("r"))
    return cells.select("file", *[F.get("r", F.nullif(F.array_position("names", c), F.lit(0).cast("long")).cast("int") - 1).alias(c) for c in wanted])


def header_lines(spark: SparkSession, path: str, required: list[str], sep: str) -> tuple[DataFrame, DataFrame]:
    """All lines with their place in their file, and each file's header: its place (head) and names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    names = F.transform(F.split(F.regexp_replace("value", "^\ufeff", ""), rf"\Q{sep}\E"), lambda x: F.trim(F.trim(F.trim(x), F.lit('"'))))
    named = lines.withColumn("names", names).where(F.size(F.array_except(F.array(*map(F.lit, required)), "names")) == 0)
    return lines, named.groupBy("file").agg(F.min(F.struct("block", "at")).alias("head"), F.min_by("names", F.struct("block", "at")).alias("names"))


def headless(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    """file of the files that have no line with all required names. Spark's listing leaves out files of no bytes."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"))
    heads = header_lines(spark, path, required, sep)[1].select(F.regexp_replace("file", "^file:/+", "file:///").alias("file"))
    return files.join(heads, "file", "left_anti")


def number_in(file: Column, pattern: str) -> Column:
    """The number that the pattern's group finds in the file's name, or -1."""
    return F.coalesce(F.nullif(F.regexp_extract(F.element_at(F.split(file, "/"), -1), pattern, 1), F.lit("")).cast("int"), F.lit(-1))


def turbine_status(spark: SparkSession, glob: str) -> DataFrame:
    """Status CSV files, each with lines of preamble before its own header; the turbine's number is in the file name."""
    rows = headed(spark, glob, ["Timestamp start", "Status", "Code"], ["Timestamp start", "Status", "Code", "Message", "IEC category"])
    named_ = {"timestamp": F.try_to_timestamp("Timestamp start"), "status": F.col("Status"), "code": F.col("Code"), "message": F.col("Message"), "category": F.col("IEC category")}
    return rows.select(number_in(F.col("file"), r"Status_[A-Za-z]+_(\d+)_").alias("turbine"), *[v.alias(k) for k, v in named_.items()]).where("timestamp is not null")


def patient_hours(spark: SparkSession, glob: str, channels: list[str], limit: int | None = None) -> DataFrame:
    """Pipe-separated files, one per patient, whose own headers name the channels; the patient's number is in the name.
    Files without header are left out (see headless), channels that a file doesn't have are null."""
    rows = headed(spark, glob, ["ICULOS"], ["ICULOS", "SepsisLabel", *channels], "|", strict=False)
    known = lambda c, kind: F.nullif(F.col(c), F.lit("NaN")).try_cast(kind).alias(c)
    patient = number_in(F.col("file"), r"(\d+)").cast("long")
    out = rows.select(patient.alias("patient"), known("ICULOS", "int").alias("hour"), known("SepsisLabel", "int").alias("label"), *[known(c, "double") for c in channels])
    if limit is not None:
        first = out.select("patient").distinct().orderBy("patient").limit(limit)
        out = out.join(F.broadcast(first), "patient", "left_semi") if limit <= 100_000 else out.join(first, "patient", "left_semi")
    return out


def labelled_cross_section(spark: SparkSession, path: str, preamble: int = 20) -> DataFrame:
    """A CSV with lines of preamble, na as null, then nulls as 0; label is 1 for pos."""
    rows = spark.read.text(path)
    found = rows.where(F.col("value").startswith("class,")).first()
    if found is None:
        raise ValueError(f"no header with class in {path}")
    header = found[0].split(",")
    body = rows.where(F.col("value").rlike(r"^(pos|neg),"))
    schema = "class string, " + ", ".join(f"`{c}` double" for c in header[1:])
    parsed = body.select(F.from_csv("value", schema, {"nullValue": "na"}).alias("r")).select("r.*")
    return parsed.select((F.col("class") == "pos").cast("int").alias("label"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in header[1:]])


def scada(spark: SparkSession, path: str, columns: list[str], time: str = "# Date and time") -> DataFrame:
    """Chosen columns of a wide CSV with the times parsed, ascending; the others aren't read."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.to_timestamp(F.col(f"`{time}`")).alias("timestamp"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).orderBy("timestamp")


def counter_tables(spark: SparkSession, readouts: str, survival: str) -> dict[str, DataFrame]:
    """Two CSV files with headers: readouts (vehicle_id, time_step and the counters, which only the header names) and
    survival (vehicle_id, length_of_study_time_step, in_study_repair)."""
    named_ = spark.read.option("header", True).csv(readouts).columns
    kinds = {"vehicle_id": "long"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in named_)
    reader = spark.read.option("header", True)
    return {"readouts": reader.schema(schema).csv(readouts), "survival": reader.schema("vehicle_id long, length_of_study_time_step double, in_study_repair int").csv(survival)}


def join_rate(failures: DataFrame, records: DataFrame, keys: list[str], seed: Column | None = None) -> DataFrame:
    """How many failures have a record with the same keys: failures, matched, rate, and those without one that `seed`
    doesn't explain (planted by the generator). Records are met once per key."""
    known = records.select(*keys).distinct().withColumn("__there", F.lit(True))
    rows = failures.withColumn("__seed", F.coalesce(seed, F.lit(False)) if seed is not None else F.lit(False)).join(known, keys, "left")
    there = F.coalesce("__there", F.lit(False))
    return rows.agg(F.count("*").alias("failures"), F.count_if(there).alias("matched"), F.avg(there.cast("double")).alias("rate"), F.count_if(~there & ~F.col("__seed")).alias("unexplained"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_stats(stats: dict, df: DataFrame, path: str) -> None:
    """A row of statistics as JSON."""
    df.sparkSession.createDataFrame([(json.dumps(stats, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, top: int) -> str:
    """The first rows as a Markdown table."""
    rows = df.limit(top).collect()
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *[" | ".join(map(str, r)) for r in rows]]
    return "\n".join(f"| {x} |" for x in lines)


def coded(sequences: DataFrame, seq: str = "items", key: str = "window_id") -> tuple[DataFrame, DataFrame]:
    """Item sequences (one per key) as text of ascending codes, -1 after each item and -2 at the end, without empty
    ones; and the codes (item, code) in order of the items. Codes meet the items by a join, so no task holds them all."""
    codes = ranked(sequences.select(F.explode(seq).alias("item")).distinct(), [F.col("item")], "code")
    places = sequences.select(key, F.posexplode(seq).alias("i", "item")).join(codes, "item")
    rows = places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "code"))).alias("s"))
    text = F.concat(F.array_join(F.transform("s", lambda x: F.concat(x["code"].cast("string"), F.lit(" -1"))), " "), F.lit(" -2"))
    return rows.select(key, text.alias("line")), codes


def decoded(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """Mined patterns of such text (`1 -1 2 -1 #SUP: 7`) as (sequence, support); lines without a support are none."""
    rows = lines.select("value", F.regexp_extract("value", r"#SUP:\s*(\d+)", 1).alias("support")).where("support <> ''")
    parts = rows.select("value", F.col("support").cast("long").alias("support"), F.posexplode(F.regexp_extract_all(F.regexp_replace("value", "#SUP:.*", ""), F.lit(r"(\d+)\s+-1"), 1)).alias("i", "code"))
    named_ = parts.withColumn("code", F.col("code").cast("long")).join(codes, "code")
    return named_.groupBy("value", "support").agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("s")).select(F.col("s.item").alias("sequence"), "support")


# Normalisation to canonical events.


def machine_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Errors; maintenance, as replacement where the same component failed then; and failures."""
    failed = tables["failures"].select("datetime", "machineID", F.col("failure").alias("comp"), F.lit(True).alias("failed"))
    errors = tables["errors"].select("machineID", "datetime", F.lit("software_error").alias("event_type"), F.col("errorID").alias("event_subtype"))
    maint = tables["maint"].join(failed, ["datetime", "machineID", "comp"], "left").select(
        "machineID", "datetime", F.when(F.col("failed"), "component_replacement").otherwise("maintenance").alias("event_type"), F.col("comp").alias("event_subtype")
    )
    failures = tables["failures"].select("machineID", "datetime", F.lit("terminal_failure").alias("event_type"), F.col("failure").alias("event_subtype"))
    return canonical(errors.unionByName(maint).unionByName(failures), "machineID", "datetime")


def canonical(df: DataFrame, entity: str, time: str) -> DataFrame:
    return df.select(F.col(entity).alias("entity_id"), F.col(time).alias("timestamp"), "event_type", "event_subtype")


#: What the states of a batch task are called.
TASK_STATES = {"Failed": "task_failure", "Terminated": "task_success", "Waiting": "task_waiting", "Running": "task_running"}


def named(column: str, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(column)]


def task_events(tasks: DataFrame, epoch: str = "2018-01-01") -> DataFrame:
    """Other states are dropped; the start stands for an end that wasn't recorded (0); the role begins the name."""
    seconds = F.when(F.col("end_time") == 0, F.col("start_time")).otherwise(F.col("end_time"))
    role = F.coalesce(F.nullif(F.regexp_extract("task_name", "^([A-Za-z]+)", 1), F.lit("")), F.lit("OTHER"))
    start = F.unix_timestamp(F.lit(epoch), "yyyy-MM-dd")
    rows = tasks.where(F.col("status").isin(*TASK_STATES)).select("job_name", F.timestamp_seconds(start + seconds).alias("time"), named("status", TASK_STATES).alias("event_type"), role.alias("event_subtype"))
    return canonical(rows, "job_name", "time")


#: The components of the system log that keep their name.
COMPONENTS = ["RAS", "KERNEL", "APP", "MMCS", "DISCOVERY", "MONITOR", "LINKCARD", "BGLMASTER", "CMCS", "HARDWARE"]


def log_events(lines: DataFrame, components: list[str] | None = None) -> DataFrame:
    """Alerts by label; else errors with component and severity, warnings and information; other lines are malformed."""
    part = F.when(F.col("component").isin(*(components or COMPONENTS)), F.col("component")).otherwise("OTHER")
    alert = (F.col("label") != "-") & F.col("label").rlike("^[A-Z]+$")
    severity = F.col("severity")
    kind = F.when(alert, "terminal_alert").when(severity.isin("FATAL", "ERROR", "SEVERE", "FAILURE"), "system_error").when(severity == "WARNING", "system_warning").when(severity == "INFO", "system_info")
    detail = F.when(alert, F.col("label")).otherwise(F.concat_ws(":", part, severity))
    rows = lines.where(~F.col("malformed")).select("rack", F.timestamp_seconds("seconds").alias("time"), kind.alias("event_type"), detail.alias("event_subtype")).where("event_type is not null")
    return canonical(rows, "rack", "time")


#: Status messages of the turbines.
STATUS = {"Warning": "system_warning", "Stop": "system_stop", "Informational": "system_info", "Communication": "system_comm"}


def turbine_events(rows: DataFrame, pattern: str = "T%d") -> DataFrame:
    """A row per known status, and one more failure row with the same time and code for each forced outage."""
    base = rows.select(F.format_string(pattern, F.col("turbine")).alias("entity"), "timestamp", "status", "code", "category")
    known = base.where(F.col("status").isin(*STATUS)).select("entity", "timestamp", named("status", STATUS).alias("event_type"), F.col("code").alias("event_subtype"))
    outage = base.where(F.col("category") == "Forced outage").select("entity", "timestamp", F.lit("terminal_failure").alias("event_type"), F.col("code").alias("event_subtype"))
    return canonical(known.unionByName(outage), "entity", "timestamp")


#: Channel, direction and limit of the clinical rules.
RULES = [
    ("HR", "high", 100.0), ("HR", "low", 60.0), ("Temp", "high", 38.0), ("Temp", "low", 36.0), ("Resp", "high", 22.0), ("SBP", "low", 100.0),
    ("MAP", "low", 65.0), ("O2Sat", "low", 92.0), ("Lactate", "high", 2.0), ("WBC", "high", 12.0), ("WBC", "low", 4.0), ("Creatinine", "high", 1.2),
    ("Bilirubin_total", "high", 1.2), ("Platelets", "low", 150.0), ("BUN", "high", 20.0), ("pH", "low", 7.35), ("HCO3", "low", 22.0), ("FiO2", "high", 0.5),
]


def patient_time(epoch: str = "2015-01-01") -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(epoch), "yyyy-MM-dd") + F.col("patient") * 3600 + F.col("hour") * 3600)


def threshold_events(hours: DataFrame, rules: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """An event (channel, direction) for each hour and rule that holds strictly; the first labelled hour is the failure.
    Channels that hours lacks are passed over."""
    rules = [r for r in rules or RULES if r[0] in hours.columns]
    held = [F.when(F.col(c) > v if way == "high" else F.col(c) < v, F.struct(F.lit(c).alias("event_type"), F.lit(way).alias("event_subtype"))) for c, way, v in rules]
    events = hours.select("patient", patient_time().alias("time"), F.explode(F.array_compact(F.array(*held))).alias("e")).select("patient", "time", "e.event_type", "e.event_subtype")
    first = hours.where("label = 1").groupBy("patient").agg(F.min("hour").alias("hour")).select("patient", patient_time().alias("time"), F.lit("terminal_failure").alias("event_type"), F.lit("sepsis").alias("event_subtype"))
    return canonical(events.unionByName(first), "patient", "time")


def counter_steps(readouts: DataFrame, survival: DataFrame) -> DataFrame:
    """(entity_id, time_step, event_type, event_subtype): a surprise where a counter's step is above the vehicle's own 0.9
    quantile, and a repair at the last readout of each vehicle that survival says was repaired."""
    counters = [f"`{c}`" for c in readouts.columns if c not in ("vehicle_id", "time_step")]
    rows = readouts.select(F.col("vehicle_id").alias("entity_id"), F.col("time_step").alias("us"), F.lit(0).alias("ordinal"), *[F.col(c).cast("double").alias(c.strip("`")) for c in counters])
    found = surprises(rows, counters).select("entity_id", F.col("us").alias("time_step"), F.lit("counter_surprise").alias("event_type"), F.col("channel").alias("event_subtype"))
    repaired = survival.where("in_study_repair = 1").select(F.col("vehicle_id").alias("entity_id")).distinct()
    last = readouts.groupBy(F.col("vehicle_id").alias("entity_id")).agg(F.max("time_step").alias("time_step"))
    ends = last.join(repaired, "entity_id", "left_semi").select("entity_id", "time_step", F.lit("terminal_repair").alias("event_type"), F.lit("repair").alias("event_subtype"))
    return found.unionByName(ends)


def counter_events(tables: dict[str, DataFrame], epoch: str = "2019-01-01") -> DataFrame:
    """counter_steps as canonical events; a time step is a day."""
    seconds = F.unix_timestamp(F.lit(epoch), "yyyy-MM-dd") + F.col("time_step") * 86_400
    return canonical(counter_steps(**tables).withColumn("timestamp", F.timestamp_seconds(seconds)), "entity_id", "timestamp")

"""From source files to records and links.

Every file is parsed once, into a table whose rows are numbered in file order. A record is
``(key, source, local_id)`` with raw property columns; keys are ``source:local_id`` and are
unique within a type. Adapters only select, explode and union; repeated keys are merged
afterwards, the last non-empty value of each field in file order winning, and values are
normalized once. Records and links are numbered in the order of sources and rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.normalize import normalize, normalize_all
from evigraph.ontology import EntityType, Ontology
from evigraph.runtime import count_rows, exists, materialize, number_rows

#: Order of sources; positions of records and links follow it.
SOURCES = ("natreg", "hr", "bank", "corpreg", "txn", "comms", "watch")

NATREG = "record_id string, surname string, given_names string, date_of_birth string, national_id string, residential_address string, city string, country string, nationality string"
HR = "staff_id string, display_name string, date_of_birth string, work_email string, mobile string, job_title string, employer_id string, employer_name string, employer_country string, start_date string"
BANK = (
    "kyc_id string, account_no string, iban string, bank string, ccy string, opened_on string, holder_type string, holder_name string, holder_dob string, "
    "holder_address string, holder_phone string, holder_email string, holder_reg string, holder_country string"
)
CORPREG = (
    "entry_id string, entry_kind string, company_name string, registration_number string, jurisdiction string, incorporated_on string, sic_description string, "
    "registered_office struct<street:string,city:string,postcode:string,country:string>, "
    "officers array<struct<officer_id:string,name:string,dob:string,role:string,appointed:string,nationality:string>>, parent_reg string, child_reg string, percent double"
)
TXN = "txn_id string, debit_account string, credit_account string, amount double, ccy string, value_date string, narrative string"
_SIDE = "struct<selector_id:string,msisdn:string,address:string>"
COMMS = f"event_id string, channel string, originator {_SIDE}, recipient {_SIDE}, timestamp string"
WATCH = "listing_id string, subject_name string, date_of_birth string, nationality string, category string, listed_on string"


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a CSV file with a header or of a JSON lines file, with ``__n`` counting them in file order."""
    reader = spark.read.schema(schema)
    rows = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.json(path)
    # rows of one block are read in order, whatever block a task takes first
    named = rows.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    return materialize(number_rows(materialize(named, "parsed"), ["__f", "__b", "__m"], "__n").drop("__f", "__b", "__m"), "rows")


def merge_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: of every other column the last value that is not null (nor empty)."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    kinds = {f.name: f.dataType for f in rows.schema}

    def filled(c: str) -> Column:
        if isinstance(kinds[c], T.StringType):
            return F.nullif(F.col(c), F.lit(""))
        return F.when(F.size(c) > 0, F.col(c)) if isinstance(kinds[c], T.ArrayType) else F.col(c)

    return rows.groupBy(*keys).agg(*[F.max_by(filled(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in others])


@dataclass
class Parts:
    """What one source yields: raw records by type, and links."""

    records: dict[str, list[DataFrame]] = field(default_factory=dict)
    links: list[DataFrame] = field(default_factory=list)

    def add(self, entity_type: str, frame: DataFrame) -> None:
        self.records.setdefault(entity_type, []).append(frame)


def _order(k: Column | None, phase: int = 0) -> Column:
    """Where a row stands: what it is read in, its number, and which of that row's it is."""
    return F.struct(F.lit(phase).alias("phase"), F.col("__n").alias("n"), (F.lit(0) if k is None else k).cast("long").alias("k")).alias("at")


def _records(rows: DataFrame, source: str, local: Column, k: Column | None = None, **props: Column) -> DataFrame:
    return rows.select(
        F.concat(F.lit(f"{source}:"), local).alias("key"), F.lit(source).alias("source"), local.alias("local_id"), _order(k),
        *[F.nullif(F.trim(v.cast("string")), F.lit("")).alias(name) for name, v in props.items()],
    ).where("key IS NOT NULL")


def _links(rows: DataFrame, source: str, link_type: str, local: Column, start: Column, end: Column, amount: Column | None = None, date: Column | None = None, k: Column | None = None, phase: int = 0, **attrs: Column) -> DataFrame:
    pairs = [x for name, v in attrs.items() for x in (F.lit(name), v.cast("string"))]
    table = F.map_filter(F.create_map(*pairs), lambda n, v: v.isNotNull() & (v != "")) if pairs else F.create_map().cast("map<string,string>")
    made = rows.select(
        F.lit(SOURCES.index(source)).alias("rank"), _order(k, phase),
        F.concat(F.lit(f"{source}:"), local).alias("link_key"), F.lit(link_type).alias("link_type"), F.concat(F.lit(f"{source}:"), start).alias("source_key"), F.concat(F.lit(f"{source}:"), end).alias("target_key"),
        (F.lit(None) if amount is None else amount).cast("double").alias("amount"), (F.lit(None) if date is None else date).cast("string").alias("date"), table.alias("attrs"),
    )
    return made.where("source_key IS NOT NULL AND target_key IS NOT NULL AND source_key <> target_key")


def natreg(rows: DataFrame, nationality: str = "country") -> Parts:
    """Population register: people and where they live. ``nationality`` names the column to use."""
    c, out = F.col, Parts()
    name = F.concat_ws(" ", c("given_names"), c("surname"))
    out.add("person", _records(rows, "natreg", c("record_id"), full_name=name, dob=c("date_of_birth"), national_id=c("national_id"), address=c("residential_address"), nationality=c(nationality)))
    home = rows.where("residential_address <> ''")
    place = F.concat(F.lit("LOC"), c("record_id"))
    out.add("location", _records(home, "natreg", place, address=c("residential_address"), city=c("city"), country=c("country")))
    out.links.append(_links(home, "natreg", "resides_at", F.concat(F.lit("RES"), c("record_id")), c("record_id"), place))
    return out


def hr(rows: DataFrame) -> Parts:
    """Staff directory: informal names, contact details, employers."""
    c, out = F.col, Parts()
    out.add("person", _records(rows, "hr", c("staff_id"), full_name=c("display_name"), dob=c("date_of_birth"), email=c("work_email"), phone=c("mobile"), occupation=c("job_title")))
    out.add("organization", _records(rows, "hr", c("employer_id"), legal_name=c("employer_name"), country=c("employer_country")))
    out.links.append(_links(rows, "hr", "employed_by", F.concat(F.lit("EMP"), c("staff_id")), c("staff_id"), c("employer_id"), date=c("start_date"), role=c("job_title"), since=c("start_date")))
    return out


def bank(rows: DataFrame) -> Parts:
    """Customer files of banks: accounts and their holders."""
    c, out = F.col, Parts()
    account, holder = F.concat(c("kyc_id"), F.lit("A")), F.concat(c("kyc_id"), F.lit("H"))
    out.add("account", _records(rows, "bank", account, account_number=c("account_no"), iban=c("iban"), institution=c("bank"), currency=c("ccy"), opened=c("opened_on")))
    people, firms = rows.where("holder_type = 'individual'"), rows.where("coalesce(holder_type, '') <> 'individual'")
    out.add("person", _records(people, "bank", holder, full_name=c("holder_name"), dob=c("holder_dob"), address=c("holder_address"), phone=c("holder_phone"), email=c("holder_email")))
    out.add("organization", _records(firms, "bank", holder, legal_name=c("holder_name"), reg_number=c("holder_reg"), address=c("holder_address"), country=c("holder_country")))
    out.links.append(_links(people, "bank", "owns_account", F.concat(F.lit("OWN"), c("kyc_id")), holder, account))
    out.links.append(_links(firms, "bank", "controls_account", F.concat(F.lit("CTL"), c("kyc_id")), holder, account))
    return out


def corpreg(rows: DataFrame) -> Parts:
    """Company register: companies, offices, officers and shareholdings."""
    c, out = F.col, Parts()
    firms = rows.where("coalesce(entry_kind, '') <> 'shareholding'")
    office = c("registered_office")
    out.add("organization", _records(firms, "corpreg", c("entry_id"), legal_name=c("company_name"), reg_number=c("registration_number"), country=c("jurisdiction"), incorporated=c("incorporated_on"), sector=c("sic_description"), address=office["street"]))
    seated = firms.where(F.coalesce(office["street"], F.lit("")) != "")
    place = F.concat(F.lit("LOC"), c("entry_id"))
    out.add("location", _records(seated, "corpreg", place, address=office["street"], city=office["city"], country=office["country"], postcode=office["postcode"]))
    out.links.append(_links(seated, "corpreg", "registered_at", F.concat(F.lit("REG"), c("entry_id")), c("entry_id"), place))
    boards = firms.select("entry_id", "__n", F.posexplode("officers").alias("seat", "o"))
    o, seat = c("o"), c("seat")
    # the office held belongs to the link: as an occupation it would contradict the staff directory
    out.add("person", _records(boards, "corpreg", o["officer_id"], seat, full_name=o["name"], dob=o["dob"], nationality=o["nationality"]))
    out.links.append(_links(boards, "corpreg", "officer_of", F.concat(F.lit("OFF"), o["officer_id"]), o["officer_id"], c("entry_id"), date=o["appointed"], k=seat + 1, role=o["role"], since=o["appointed"]))
    known = firms.where("registration_number <> ''").groupBy("registration_number").agg(F.max_by("entry_id", "__n").alias("entry"))  # the last registrant
    stakes = number_rows(rows.where("entry_kind = 'shareholding'").select("parent_reg", "child_reg", "percent", "__n"), ["__n"], "stake")
    held = stakes.join(known.select(c("registration_number").alias("parent_reg"), c("entry").alias("parent")), "parent_reg")
    held = held.join(known.select(c("registration_number").alias("child_reg"), c("entry").alias("child")), "child_reg")
    # stakes are linked when all companies are known
    out.links.append(_links(held, "corpreg", "owns_stake", F.format_string("SH%05d", "stake"), c("parent"), c("child"), phase=1, percent=c("percent")))
    return out


def transactions(rows: DataFrame) -> Parts:
    """Payments: every account number seen is a thin record."""
    c, out = F.col, Parts()
    numbers = rows.select("__n", F.posexplode(F.array("debit_account", "credit_account")).alias("side", "number"))
    out.add("account", _records(numbers, "txn", F.concat(F.lit("ACC"), c("number")), c("side"), account_number=c("number")))
    ends = [F.concat(F.lit("ACC"), c(x)) for x in ("debit_account", "credit_account")]
    out.links.append(_links(rows, "txn", "transacted", c("txn_id"), *ends, amount=c("amount"), date=c("value_date"), currency=c("ccy"), reference=c("narrative")))
    return out


def communications(rows: DataFrame) -> Parts:
    """Who called or wrote to whom, by number or address only."""
    c, out = F.col, Parts()
    sides = rows.select("__n", F.posexplode(F.array("originator", "recipient")).alias("side", "s"))
    s = c("s")
    some = lambda x: (F.coalesce(x["msisdn"], F.lit("")) != "") | (F.coalesce(x["address"], F.lit("")) != "")
    out.add("person", _records(sides.where(some(s)), "comms", s["selector_id"], c("side"), phone=s["msisdn"], email=s["address"]))
    whole = rows.where(some(c("originator")) & some(c("recipient")))
    out.links.append(_links(whole, "comms", "communicated", c("event_id"), c("originator.selector_id"), c("recipient.selector_id"), date=c("timestamp"), channel=c("channel")))
    return out


def watchlist(rows: DataFrame) -> Parts:
    """Listed people: name, date of birth and nationality."""
    c, out = F.col, Parts()
    out.add("person", _records(rows, "watch", c("listing_id"), full_name=c("subject_name"), dob=c("date_of_birth"), nationality=c("nationality")))
    return out


#: Files in the order they are read, with their columns and adapters.
ADAPTERS: dict[str, tuple[str, Callable[[DataFrame], Parts]]] = {
    "natreg_persons.csv": (NATREG, natreg),
    "hr_directory.csv": (HR, hr),
    "bank_kyc.jsonl": (BANK, bank),
    "company_registry.jsonl": (CORPREG, corpreg),
    "transactions.jsonl": (TXN, transactions),
    "comms_metadata.jsonl": (COMMS, communications),
    "watchlist.csv": (WATCH, watchlist),
}


@dataclass
class Ingested:
    """Normalized records by type, links, and rows read per file."""

    records: dict[str, DataFrame]
    links: DataFrame | None
    report: dict[str, int]


def normalize_records(raw: DataFrame, entity: EntityType) -> DataFrame:
    """Known properties normalized, lists element by element, others dropped."""
    out = []
    for p in entity.properties.values():
        if p.name in raw.columns:
            listed = isinstance(raw.schema[p.name].dataType, T.ArrayType)
            out.append((normalize_all if listed else normalize)(p.kind, F.col(p.name)).alias(p.name))
    return raw.select("key", "source", "local_id", "at", *out)


def gather(frames: list[DataFrame], entity: EntityType) -> DataFrame:
    """One record per key, in the order of sources and of the rows that named it first."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    keys = ["key", "source", "local_id"]
    merged = merge_by_key(whole, keys, "at")
    firsts = whole.groupBy(*keys).agg(F.min("at").alias("at"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    ready = normalize_records(merged.join(firsts, keys), entity).withColumn("rank", rank)
    return number_rows(ready, ["rank", "at", "key"], "pos").drop("rank", "at")


def ingest(spark: SparkSession, folder: str, ontology: Ontology) -> Ingested:
    """Read every known file in a folder; files that are not there are skipped."""
    parts, report = Parts(), {}
    for name, (schema, adapter) in ADAPTERS.items():
        path = f"{folder.rstrip('/')}/{name}"
        if not exists(spark, path):
            continue
        rows = read_rows(spark, path, schema)
        report[name] = count_rows(rows)
        got = adapter(rows)
        for kind, frames in got.records.items():
            for frame in frames:
                parts.add(kind, frame)
        parts.links += got.links
    records = {kind: gather(frames, ontology.entity(kind)) for kind, frames in parts.records.items()}
    links = None
    for frame in parts.links:
        links = frame if links is None else links.unionByName(frame)
    if links is not None:
        links = materialize(number_rows(links, ["rank", "at", "link_type", "link_key"], "ord").drop("rank", "at"), "links")
    return Ingested(records, links, report)


def read_truth(spark: SparkSession, folder: str) -> DataFrame | None:
    """``(key, truth_id)`` from ``truth.json``, one object with a map ``records``, if the folder has it."""
    path = f"{folder.rstrip('/')}/truth.json"
    if not exists(spark, path):
        return None
    whole = spark.read.schema("records map<string,string>").option("multiLine", True).json(path)
    return whole.select(F.explode("records").alias("key", "truth_id"))

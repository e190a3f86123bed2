"""A synthetic corpus with known truth, made by hashing ids: the same seed gives the same rows.

People and companies leave traces in seven sources under varying names and dates; a ring of
shell companies with common officers and circular payments is planted among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.runtime import count_rows, number_rows

FIRST = "Robert William Elizabeth Katherine James Margaret Thomas Susan Michael Jennifer Daniel Rebecca Andrew Victoria Nicholas Abigail Gregory Isabella Matthew Sophia Lena Oscar Ingrid Pavel Amara Tariq Yara Hugo Noor Felix".split()
SHORT = {"Robert": "Bob", "William": "Bill", "Elizabeth": "Liz", "Katherine": "Kate", "James": "Jim", "Margaret": "Meg", "Thomas": "Tom", "Susan": "Sue", "Michael": "Mike", "Jennifer": "Jen", "Daniel": "Dan", "Rebecca": "Becky", "Andrew": "Andy", "Victoria": "Vicky", "Nicholas": "Nick", "Matthew": "Matt"}
HEAD = "Ash Bren Cal Dray Elm Fair Gar Hol Ing Kes Lang Mor Nor Oak Pem Quin Ross Stan Thorn Wel".split()
TAIL = "bourne croft dale ford gate hurst ley more ridge shaw stead ton vale wick worth".split()
TRADE_A = "Amber Atlas Beacon Cedar Cobalt Delta Ember Falcon Granite Harbor Indigo Juniper Kestrel Lumen Meridian Nimbus Orchid Pinnacle Quartz Raven Sable Tundra Umber Vertex".split()
TRADE_B = "Capital Logistics Minerals Holdings Trading Partners Shipping Energy Foods Textiles Systems Ventures".split()
FORMS = ("Ltd", "GmbH", "PLC", "S.A.", "LLC")
STREETS = ("Station", "Mill", "Church", "Victoria", "Park", "Bridge", "Castle", "Garden", "Harbour", "Forest")
KINDS = ("Street", "Road", "Avenue", "Lane")
COUNTRIES = ("gb", "de", "fr", "cy", "ae", "nl")
CITIES = ("London", "Berlin", "Paris", "Nicosia", "Dubai", "Rotterdam")
JOBS = ("analyst", "engineer", "director", "accountant", "clerk", "consultant")
SECTORS = ("commodities", "shipping", "software", "retail", "real estate")
MIDDLES = ("", "", "A", "B", "C", "E", "H", "J", "L", "M", "R", "S")
BANKS = ("First Union Bank", "Harbour Trust", "Nordbank AG", "Credit Azur")
RING_PEOPLE, RING_ORGS = 6, 5


class Dice:
    """Choices that depend on the seed, a salt and the row alone."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def u(self, salt: str, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(salt), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def n(self, salt: str, size: int | Column, *keys: Column) -> Column:
        return F.floor(self.u(salt, *keys) * size).cast("long")

    def pick(self, values, salt: str, *keys: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (self.n(salt, len(values), *keys) + 1).cast("int"))

    def digits(self, count: int, salt: str, *keys: Column) -> Column:
        return F.lpad(F.pmod(F.xxhash64(F.lit(self.seed), F.lit(salt), *keys), F.lit(10**count)).cast("string"), count, "0")

    def maybe(self, value: Column, share: float, salt: str, *keys: Column) -> Column:
        return F.when(self.u(salt, *keys) < share, value)


#: Rows of a keyboard; a finger slips to the next key of its row.
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def typo(text: Column, dice: Dice, salt: str, *keys: Column) -> Column:
    """One letter dropped, doubled, swapped with the next or hit beside its key."""
    at = (dice.n(salt + "@", F.greatest(F.length(text) - 2, F.lit(1)), *keys) + 2).cast("int")
    head, tail = F.substring(text, F.lit(1), at - 1), F.substr(text, at + 1)
    letter, after = F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1))
    beside = F.translate(F.lower(letter), "".join(row[:-1] for row in KEY_ROWS), "".join(row[1:] for row in KEY_ROWS))
    kind = dice.n(salt + "?", 4, *keys)
    made = F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, letter, letter, tail))
    made = made.when(kind == 2, F.concat(head, after, letter, F.substr(text, at + 2))).otherwise(F.concat(head, beside, tail))
    return F.when(F.length(text) < 4, text).otherwise(made)


def name_variant(first: Column, middle: Column, last: Column, noise: float, dice: Dice, salt: str, *keys: Column) -> Column:
    """A name as a busy clerk writes it: short form or initial, reversed, typo, capitals, title."""
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SHORT.items() for x in p]), first), first)
    roll = dice.u(salt + "kind", *keys)
    given = F.when(roll < 0.18, short).when(roll < 0.30, F.concat(F.substring(first, 1, 1), F.lit("."))).otherwise(first)
    given = F.when((dice.u(salt + "middle", *keys) < 0.45) & (middle != ""), F.concat_ws(" ", given, middle)).otherwise(given)
    text = F.when(dice.u(salt + "order", *keys) < 0.06, F.concat(last, F.lit(", "), given)).otherwise(F.concat_ws(" ", given, last))
    text = F.when(dice.u(salt + "typo", *keys) < noise, typo(text, dice, salt, *keys)).otherwise(text)
    text = F.when(dice.u(salt + "upper", *keys) < 0.05, F.upper(text)).otherwise(text)
    return F.when(dice.u(salt + "title", *keys) < 0.04, F.concat(F.lit("Dr "), text)).otherwise(text)


def date_variant(day: Column, noise: float, dice: Dice, salt: str, *keys: Column) -> Column:
    """A date in one of three layouts; at half the noise with day and month exchanged, a day off, or missing."""
    roll = dice.u(salt + "wrong", *keys) / (noise / 2 or 1e-9)
    swapped = F.when(F.day(day) <= 12, F.make_date(F.year(day), F.day(day), F.month(day)))
    off = F.date_add(day, F.when(dice.u(salt + "way", *keys) < 0.5, 1).otherwise(-1))
    wrong = F.when(roll >= 1, day).when((roll < 0.4) & swapped.isNotNull(), swapped).when(roll < 0.7, off)
    kind = dice.n(salt + "layout", 3, *keys)
    return F.when(kind == 0, F.date_format(wrong, "yyyy-MM-dd")).when(kind == 1, F.date_format(wrong, "dd/MM/yyyy")).otherwise(F.date_format(wrong, "dd MMM yyyy"))


def phone_variant(phone: Column, dice: Dice, salt: str, *keys: Column) -> Column:
    kind, cut = dice.n(salt, 4, *keys), lambda layout: F.regexp_replace(phone, r"^(\d{3})(\d{3})(\d+)$", layout)
    return F.when(kind == 0, cut("+44 $1 $2 $3")).when(kind == 1, cut("0$1-$2-$3")).when(kind == 2, cut("($1) $2$3")).otherwise(phone)


def email_variant(email: Column, dice: Dice, salt: str, *keys: Column) -> Column:
    """Dots where they do not count, a tag, or capitals."""
    kind, half = dice.n(salt, 4, *keys), F.floor(F.instr(email, "@") / 2).cast("int")
    dotted = F.concat(F.substring(email, F.lit(1), half), F.lit("."), F.substr(email, half + 1))
    tag = F.concat(F.lit("+"), dice.pick(("work", "personal", "biz"), salt + "tag", *keys), F.lit("@"))
    return F.when((kind == 0) & F.endswith(email, F.lit("@gmail.com")) & (half > 2), dotted).when(kind == 1, F.replace(email, F.lit("@"), tag)).when(kind == 2, F.upper(email)).otherwise(email)


def address_variant(address: Column, dice: Dice, salt: str, *keys: Column) -> Column:
    short = address
    for word, brief in (("Street", "St"), ("Road", "Rd"), ("Avenue", "Ave"), ("Lane", "Ln")):
        short = F.replace(short, F.lit(word), F.lit(brief))
    return F.when(dice.u(salt, *keys) < 0.45, short).otherwise(address)


def people(spark: SparkSession, n: int, dice: Dice) -> DataFrame:
    p, i = spark.range(n).withColumnRenamed("id", "p"), F.col("p")
    c = dice.n("country", len(COUNTRIES), i)
    p = p.select(
        "p", dice.pick(FIRST, "first", i).alias("first"), dice.pick(MIDDLES, "middle", i).alias("middle"), F.concat(dice.pick(HEAD, "head", i), dice.pick(TAIL, "tail", i), F.when(dice.u("twin", i) < 0.5, dice.pick(("s", "er", "man"), "end", i)).otherwise(F.lit(""))).alias("last"),
        F.date_add(F.lit("1955-01-01").cast("date"), dice.n("dob", 15_000, i).cast("int")).alias("dob"), F.concat(F.lit("N"), dice.digits(8, "nid", i)).alias("nid"), c.alias("c"),
        F.concat(F.lit("7"), dice.digits(9, "phone", i)).alias("phone"), F.concat_ws(" ", (dice.n("no", 180, i) + 1).cast("string"), dice.pick(STREETS, "street", i), dice.pick(KINDS, "kind", i)).alias("address"),
    )
    host = dice.pick(("gmail.com", "outlook.com", "fastmail.com"), "host", i)
    return p.withColumns({
        "email": F.concat(F.lower("first"), F.lit("."), F.lower("last"), F.lit("@"), host),
        "country": F.element_at(F.array(*[F.lit(x) for x in COUNTRIES]), (c + 1).cast("int")), "city": F.element_at(F.array(*[F.lit(x) for x in CITIES]), (c + 1).cast("int")),
    })


def organizations(spark: SparkSession, n: int, dice: Dice) -> DataFrame:
    o, i = spark.range(n).withColumnRenamed("id", "o"), F.col("o")
    item = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    ring, c = i < RING_ORGS, dice.n("oc", len(COUNTRIES), i)
    country = F.when(ring, F.lit("cy")).otherwise(F.element_at(F.array(*[F.lit(x) for x in COUNTRIES]), (c + 1).cast("int")))
    street = F.concat_ws(" ", (dice.n("ono", 90, i) + 200).cast("string"), dice.pick(STREETS, "ost", i), F.lit("Road"), i.cast("string"))
    # names from two lists stay distinct for 288 companies, then get a number
    name = F.concat_ws(" ", item(TRADE_A, i), item(TRADE_B, F.floor(i / len(TRADE_A)) + i), F.when(i >= len(TRADE_A) * len(TRADE_B), i.cast("string")))
    return o.select(
        "o", name.alias("name"), dice.pick(FORMS, "form", i).alias("form"), country.alias("country"), F.concat(country, dice.digits(8, "reg", i)).alias("reg"),
        F.when(ring, F.date_add(F.lit("2022-06-01").cast("date"), (i * 11).cast("int"))).otherwise(F.date_add(F.lit("1998-01-01").cast("date"), dice.n("inc", 9000, i).cast("int"))).alias("incorporated"),
        F.when(ring, F.lit("14 Harbour Street")).otherwise(street).alias("address"), F.when(ring, F.lit("1066")).otherwise(dice.digits(5, "post", i)).alias("postcode"), dice.pick(SECTORS, "sector", i).alias("sector"),
        F.when(ring, F.lit("Nicosia")).otherwise(F.element_at(F.array(*[F.lit(x) for x in CITIES]), (c + 1).cast("int"))).alias("city"),
    )


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def generate(spark: SparkSession, folder: str, seed: int = 20260813, n_people: int = 300, n_orgs: int = 80, noise: float = 0.28) -> dict:
    """Write the seven sources, ``truth.json`` and ``meta.json`` under ``folder``."""
    d, c = Dice(seed), F.col
    folder = folder.rstrip("/")
    p, o = people(spark, n_people, d), organizations(spark, n_orgs, d)
    who = lambda prefix, key: F.concat(F.lit(prefix), F.lpad(c(key).cast("string"), 6, "0"))
    truth: list[DataFrame] = []

    def label(rows: DataFrame, key: Column, prefix: str, number: str) -> None:
        truth.append(rows.select(key.alias("key"), who(prefix, number).alias("truth_id")))

    def slip(text: Column, share: float, salt: str, *keys: Column) -> Column:
        return F.when(d.u(salt, *keys) < noise * share, typo(text, d, salt, *keys)).otherwise(text)

    def write(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").csv(f"{folder}/{name}", header=True) if name.endswith("csv") else rows.write.mode("overwrite").json(f"{folder}/{name}")

    r = p.where((d.u("natreg", c("p")) < 0.93) | (c("p") < RING_PEOPLE))
    write(r.select(
        who("R", "p").alias("record_id"), F.upper("last").alias("surname"), F.trim(F.concat_ws(" ", "first", "middle")).alias("given_names"), F.date_format("dob", "yyyy-MM-dd").alias("date_of_birth"),
        c("nid").alias("national_id"), address_variant(c("address"), d, "na", c("p")).alias("residential_address"), "city", "country", c("country").alias("nationality"),
    ), "natreg_persons.csv")
    label(r, F.concat(F.lit("natreg:"), who("R", "p")), "P", "p")
    truth.append(r.select(F.concat(F.lit("natreg:LOC"), who("R", "p")).alias("key"), F.concat_ws("|", F.lit("L"), "address", "city").alias("truth_id")))

    job = p.where(d.u("hr", c("p")) < 0.82).withColumn("o", d.n("emp", n_orgs, c("p"))).join(o.select("o", c("name").alias("oname"), c("form"), c("country").alias("ocountry")), "o")
    write(job.select(
        who("H", "p").alias("staff_id"), name_variant(c("first"), c("middle"), c("last"), noise, d, "hr", c("p")).alias("display_name"), d.maybe(date_variant(c("dob"), noise, d, "hrd", c("p")), 0.7, "hd", c("p")).alias("date_of_birth"),
        d.maybe(email_variant(c("email"), d, "he", c("p")), 0.88, "hm", c("p")).alias("work_email"), d.maybe(phone_variant(c("phone"), d, "hp", c("p")), 0.72, "hq", c("p")).alias("mobile"), d.pick(JOBS, "job", c("p")).alias("job_title"),
        who("E", "o").alias("employer_id"), slip(F.concat_ws(" ", "oname", "form"), 0.4, "ho", c("p")).alias("employer_name"), c("ocountry").alias("employer_country"), F.lit("01/02/2019").alias("start_date"),
    ), "hr_directory.csv")
    label(job, F.concat(F.lit("hr:"), who("H", "p")), "P", "p")
    label(job.select("o").distinct(), F.concat(F.lit("hr:"), who("E", "o")), "O", "o")

    mine = p.select("p", F.lit(None).cast("long").alias("o"), F.explode(F.sequence(F.lit(0), F.when(d.u("acc", c("p")) < 0.05, 2).when(d.u("acc", c("p")) < 0.3, 1).otherwise(0))).alias("k"))
    accounts = mine.unionByName(o.select(F.lit(None).cast("long").alias("p"), "o", F.explode(F.sequence(F.lit(0), F.when(d.u("firm", c("o")) < 0.2, 1).otherwise(0))).alias("k")))
    tag = F.when(c("o").isNull(), F.concat(F.lit("P"), c("p"), F.lit("-"), c("k"))).otherwise(F.concat(F.lit("O"), c("o"), F.lit("-"), c("k")))
    accounts = accounts.withColumn("a", tag).withColumn("number", F.concat(F.when(c("o").isNull(), F.lit("1")).otherwise(F.lit("2")), d.digits(11, "num", c("a"))))
    kyc = accounts.join(p, "p", "left").join(o.select("o", *[c(x).alias("o_" + x) for x in ("name", "form", "reg", "country", "address")]), "o", "left").where((d.u("kyc", c("a")) < 0.95) | (c("o") < RING_ORGS))
    mine_ = c("o").isNull()
    write(kyc.select(
        F.concat(F.lit("K"), "a").alias("kyc_id"), c("number").alias("account_no"), d.maybe(F.concat(F.lit("XB"), c("number")), 0.8, "iban", c("a")).alias("iban"), d.pick(BANKS, "bank", c("a")).alias("bank"), F.lit("EUR").alias("ccy"), F.lit("05/03/2018").alias("opened_on"),
        F.when(mine_, "individual").otherwise("corporate").alias("holder_type"), F.when(mine_, name_variant(c("first"), c("middle"), c("last"), noise, d, "bk", c("a"))).otherwise(slip(F.concat_ws(" ", "o_name", "o_form"), 0.5, "bo", c("a"))).alias("holder_name"),
        F.when(mine_, date_variant(c("dob"), noise, d, "bkd", c("a"))).alias("holder_dob"), F.when(mine_, d.maybe(address_variant(c("address"), d, "ba", c("a")), 0.8, "bb", c("a"))).otherwise(address_variant(c("o_address"), d, "bz", c("a"))).alias("holder_address"),
        F.when(mine_, d.maybe(phone_variant(c("phone"), d, "bp", c("a")), 0.55, "bq", c("a"))).alias("holder_phone"), F.when(mine_, d.maybe(email_variant(c("email"), d, "be", c("a")), 0.6, "bf", c("a"))).alias("holder_email"),
        F.when(~mine_, d.maybe(c("o_reg"), 0.55, "br", c("a"))).alias("holder_reg"), F.when(~mine_, c("o_country")).alias("holder_country"),
    ), "bank_kyc.jsonl")
    truth.append(kyc.select(F.concat(F.lit("bank:K"), "a", F.lit("A")).alias("key"), F.concat(F.lit("A"), "number").alias("truth_id")))
    truth.append(kyc.select(F.concat(F.lit("bank:K"), "a", F.lit("H")).alias("key"), F.when(mine_, who("P", "p")).otherwise(who("O", "o")).alias("truth_id")))

    seats = o.where(c("o") >= RING_ORGS).select("o", F.explode(F.sequence(F.lit(0), d.n("seats", 2, c("o")).cast("int"))).alias("k")).withColumn("p", d.n("seat", n_people, c("o"), c("k")))
    ring = _rows(spark, [(s, k, (s + k) % RING_PEOPLE) for s in range(RING_ORGS) for k in range(2)] + [(RING_ORGS - 1, 2, RING_PEOPLE - 1), (0, 2, RING_PEOPLE - 1)], "o long, k int, p long")
    boards = seats.unionByName(ring).dropDuplicates(["o", "p"]).join(p, "p").withColumn("officer_id", F.concat(F.lit("F"), c("o"), F.lit("-"), c("k")))
    officer = F.struct("officer_id", name_variant(c("first"), c("middle"), c("last"), noise, d, "of", c("officer_id")).alias("name"), date_variant(c("dob"), noise, d, "ofd", c("officer_id")).alias("dob"), F.lit("director").alias("role"), F.lit("2022-07-01").alias("appointed"), c("country").alias("nationality"))
    firms = o.join(boards.groupBy("o").agg(F.array_sort(F.collect_list(officer)).alias("officers")), "o", "left").select(
        who("C", "o").alias("entry_id"), F.lit("company").alias("entry_kind"), F.concat_ws(" ", "name", "form").alias("company_name"), c("reg").alias("registration_number"), c("country").alias("jurisdiction"), F.date_format("incorporated", "yyyy-MM-dd").alias("incorporated_on"),
        c("sector").alias("sic_description"), F.struct(c("address").alias("street"), "city", "postcode", "country").alias("registered_office"), "officers",
    )
    held = o.where(d.u("stake", c("o")) < 0.25).select(c("reg").alias("parent_reg"), d.n("child", n_orgs, c("o")).alias("o"), (d.n("pct", 90, c("o")) + 5).cast("double").alias("percent")).join(o.select("o", c("reg").alias("child_reg")), "o").where("parent_reg <> child_reg")
    write(firms.unionByName(held.select(F.concat_ws("-", F.lit("SH"), "parent_reg", "child_reg").alias("entry_id"), F.lit("shareholding").alias("entry_kind"), "parent_reg", "child_reg", "percent"), allowMissingColumns=True), "company_registry.jsonl")
    label(o, F.concat(F.lit("corpreg:"), who("C", "o")), "O", "o")
    truth.append(o.select(F.concat(F.lit("corpreg:LOC"), who("C", "o")).alias("key"), F.concat_ws("|", F.lit("L"), "address", "city").alias("truth_id")))
    label(boards, F.concat(F.lit("corpreg:"), c("officer_id")), "P", "p")

    numbers = accounts.select("a", "number")
    slots = number_rows(accounts.select("a"), ["a"], "slot").withColumn("slot", F.col("slot") + 1)
    total = count_rows(slots)
    pay = spark.range(max(200, 8 * total)).select(c("id").alias("t"), (d.n("from", total, c("id")) + 1).alias("x"), (d.n("to", total, c("id")) + 1).alias("y"), F.round(F.exp(4.0 + 4.4 * d.u("amt", c("id"))), 2).alias("amount"))
    pay = pay.join(slots.select(c("slot").alias("x"), c("a").alias("src")), "x").join(slots.select(c("slot").alias("y"), c("a").alias("dst")), "y").where("src <> dst").select(F.concat(F.lit("T"), c("t")).alias("txn_id"), "src", "dst", "amount")
    circle = spark.range(14 * RING_ORGS).select(F.concat(F.lit("X"), c("id")).alias("txn_id"), F.concat(F.lit("O"), c("id") % RING_ORGS, F.lit("-0")).alias("src"), F.concat(F.lit("O"), (c("id") + 1) % RING_ORGS, F.lit("-0")).alias("dst"), F.round(8600 + 1250 * d.u("ring", c("id")), 2).alias("amount"))
    feed = spark.range(5 * RING_PEOPLE).select(F.concat(F.lit("Y"), c("id")).alias("txn_id"), F.concat(F.lit("P"), c("id") % RING_PEOPLE, F.lit("-0")).alias("src"), F.lit("O0-0").alias("dst"), F.round(9000 + 900 * d.u("feed", c("id")), 2).alias("amount"))
    flows = pay.unionByName(circle).unionByName(feed).join(numbers.select(c("a").alias("src"), c("number").alias("debit_account")), "src").join(numbers.select(c("a").alias("dst"), c("number").alias("credit_account")), "dst")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), d.n("day", 400, c("txn_id")).cast("int")), "yyyy-MM-dd")
    write(flows.select("txn_id", "debit_account", "credit_account", "amount", F.lit("EUR").alias("ccy"), day.alias("value_date"), F.lit("invoice").alias("narrative")), "transactions.jsonl")
    truth.append(flows.select(F.explode(F.array("debit_account", "credit_account")).alias("n")).distinct().select(F.concat(F.lit("txn:ACC"), "n").alias("key"), F.concat(F.lit("A"), "n").alias("truth_id")))

    calls = spark.range(max(200, 10 * n_people)).select(F.concat(F.lit("V"), c("id")).alias("e"), d.n("ca", n_people, c("id")).alias("x"), d.n("cb", n_people, c("id")).alias("y"))
    among = spark.range(8 * RING_PEOPLE * (RING_PEOPLE - 1)).select(F.concat(F.lit("W"), c("id")).alias("e"), (c("id") % RING_PEOPLE).alias("x"), ((c("id") + 1 + F.floor(c("id") / RING_PEOPLE) % (RING_PEOPLE - 1)) % RING_PEOPLE).alias("y"))
    calls = calls.unionByName(among).where("x <> y")

    def side(mark: str) -> DataFrame:
        contact = p.select("p", "phone", "email")
        key = F.concat(c("e"), F.lit(mark))
        use = d.u("use", key)
        return calls.select("e", c("x" if mark == "a" else "y").alias("p")).join(contact, "p").select(
            "e", c("p").alias("p" + mark), F.struct(key.alias("selector_id"), F.when(use < 0.7, phone_variant(c("phone"), d, "cp", key)).alias("msisdn"), F.when(use >= 0.6, email_variant(c("email"), d, "ce", key)).alias("address")).alias(mark)
        )

    both = side("a").join(side("b"), "e")
    write(both.select(c("e").alias("event_id"), d.pick(("voice", "sms", "email"), "chan", c("e")).alias("channel"), c("a").alias("originator"), c("b").alias("recipient"), F.lit("2024-03-01").alias("timestamp")), "comms_metadata.jsonl")
    label(both, F.concat(F.lit("comms:"), c("a.selector_id")), "P", "pa")
    label(both, F.concat(F.lit("comms:"), c("b.selector_id")), "P", "pb")

    listed = p.where((c("p") == 0) | ((c("p") >= RING_PEOPLE) & (d.u("watch", c("p")) < 8 / n_people)))
    write(listed.select(who("W", "p").alias("listing_id"), F.concat_ws(" ", "first", "last").alias("subject_name"), F.date_format("dob", "dd MMM yyyy").alias("date_of_birth"), c("country").alias("nationality"), F.lit("sanctions").alias("category"), F.lit("2023-01-01").alias("listed_on")), "watchlist.csv")
    label(listed, F.concat(F.lit("watch:"), who("W", "p")), "P", "p")

    whole = truth[0]
    for more in truth[1:]:
        whole = whole.unionByName(more)
    # one object with one map, as evaluation reads it
    entries = F.map_from_entries(F.collect_list(F.struct("key", "truth_id")))
    write(whole.groupBy("key").agg(F.min("truth_id").alias("truth_id")).agg(entries.alias("records")), "truth.json")
    meta = {"seed": seed, "people": n_people, "organizations": n_orgs, "noise": noise, "ring_people": [f"P{i:06d}" for i in range(RING_PEOPLE)], "ring_orgs": [f"O{i:06d}" for i in range(RING_ORGS)]}
    write(spark.createDataFrame([(str(meta["seed"]), n_people, n_orgs, meta["ring_people"], meta["ring_orgs"])], "seed string, people int, organizations int, ring_people array<string>, ring_orgs array<string>"), "meta.json")
    return meta

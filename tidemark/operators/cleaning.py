"""Raw sheet rows to clean tables: cell parsing that never raises, mapping, skip counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sheet name to (channel, source of usage).
USAGE_SHEETS = {
    "SMS_usage (BC)": ("sms", "bc"), "SMS_usage (API)": ("sms", "api"), "SMS_usage (OTP)": ("sms", "otp"),
    "Email_usage (BC)": ("email", "bc"), "Email_usage (API)": ("email", "api"), "Email_usage (OTP)": ("email", "otp"),
}
#: Day zero of spreadsheet serials.
SERIAL_EPOCH = "1899-12-30"


def excel_cell(stamp: Column) -> Column:
    """A date cell as JSON: its ISO text and its serial."""
    return F.to_json(F.struct(F.lit(True).alias("_excel"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), excel_serial(stamp).alias("serial")))


def _date_part(cell: Column, name: str) -> Column:
    """A field of a date cell; null for any other cell."""
    return F.when(cell.startswith('{"_excel"'), F.nullif(F.get_json_object(cell, f"$.{name}"), F.lit("")))


def clean_string(cell: Column) -> Column:
    """Trimmed text; of a date cell its ISO text, else its serial."""
    return F.coalesce(_date_part(cell, "iso"), _date_part(cell, "serial"), F.nullif(F.trim(cell), F.lit("")))


def clean_numeric(cell: Column) -> Column:
    """A finite number or null."""
    x = clean_string(cell).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean_int(cell: Column) -> Column:
    """Cut off toward zero."""
    x = clean_numeric(cell)
    return F.when(F.abs(x) < 9.2e18, x.cast("long"))


def clean_date(cell: Column) -> Column:
    """A date cell, an ISO date or time, or a bare number of days since the serial epoch."""
    text = clean_string(cell)
    serial = clean_numeric(cell)
    micros = F.unix_micros(F.lit(SERIAL_EPOCH).cast("timestamp")) + F.round(serial * 86_400_000_000).cast("long")
    of_serial = F.when(F.abs(serial) < 1e7, F.timestamp_micros(micros))
    return F.coalesce(of_serial, text.try_cast("timestamp"))


def clean_day(cell: Column) -> Column:
    """The UTC day of a date cell, as text (sessions run in UTC)."""
    return F.date_format(clean_date(cell), "yyyy-MM-dd")


def excel_serial(stamp: Column) -> Column:
    return (F.unix_micros(stamp.cast("timestamp")) - F.unix_micros(F.lit(SERIAL_EPOCH).cast("timestamp"))) / 86_400_000_000


def missing_headers(df: DataFrame, required: list[str]) -> list[str]:
    have = {c.strip() for c in df.columns}
    return [c for c in required if c not in have]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with anything but blanks in them."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    return df.where(F.exists(cells, lambda c: F.coalesce(F.trim(c) != "", F.lit(False))))


def to_payload(df: DataFrame, source_id: str) -> DataFrame:
    """Raw form: one map a row."""
    pairs = [x for c in df.columns for x in (F.lit(c.strip()), F.col(f"`{c}`").cast("string"))]
    return df.select(F.lit(source_id).alias("source_id"), F.create_map(*pairs).alias("row_payload"))


def cell(name: str) -> Column:
    return F.element_at("row_payload", name)


def clean_customers(raw: DataFrame) -> DataFrame:
    """All ten columns; rows without an account are skipped; missing credits are zero; headers may be long or short."""
    either = lambda *names: F.coalesce(*[cell(n) for n in names])
    day = lambda name: clean_date(cell(name)).cast("date")
    out = raw.select(
        "source_id", clean_int(cell("acc_id")).cast("int").alias("acc_id"), F.lower(clean_string(either("status (SMS)", "status_sms"))).alias("status_sms"),
        F.coalesce(clean_numeric(either("user.credit + user.credit_premium", "credit_sms")), F.lit(0.0)).alias("credit_sms"), F.coalesce(clean_numeric(cell("credit_email")), F.lit(0.0)).alias("credit_email"),
        day("expire").alias("expire_sms"), day("expire_email").alias("expire_email"), F.lower(clean_string(either("status (Email)", "status_email"))).alias("status_email"), day("join_date").alias("join_date"),
        clean_date(cell("last_access")).cast("timestamp_ntz").alias("last_access"), clean_date(cell("last_send")).cast("timestamp_ntz").alias("last_send"),
    )
    return out.where(F.col("acc_id").isNotNull())


def clean_payments(raw: DataFrame) -> DataFrame:
    out = raw.select("source_id", clean_int(cell("acc_id")).cast("int").alias("acc_id"), clean_int(cell("uid")).alias("payment_uid"), clean_date(cell("payment_date")).alias("payment_date"), clean_numeric(cell("amount")).alias("amount"), clean_numeric(cell("credit_add")).alias("credit_add"), F.lower(clean_string(cell("credit_type"))).alias("credit_type"))
    return out.where(F.col("acc_id").isNotNull() & F.col("payment_date").isNotNull())


def clean_usage(raw: DataFrame, sheet: str) -> DataFrame:
    """Usage null is zero; months out of 1..12 are kept and counted as warnings elsewhere."""
    channel, source = USAGE_SHEETS[sheet]
    out = raw.select("source_id", clean_int(cell("acc_id")).cast("int").alias("acc_id"), clean_int(cell("year")).cast("int").alias("year"), clean_int(cell("month")).cast("int").alias("month"), F.coalesce(clean_numeric(cell("usage")), F.lit(0.0)).alias("usage"), F.lit(channel).alias("channel"), F.lit(source).alias("usage_source"))
    return out.where(F.col("acc_id").isNotNull())


def usage_union(sheets: dict[str, DataFrame]) -> DataFrame:
    out = None
    for sheet, raw in sheets.items():
        one = clean_usage(raw, sheet)
        out = one if out is None else out.unionByName(one)
    return out


def clean_manifest(sheets: dict[str, DataFrame]) -> DataFrame:
    """A row a sheet: raw and clean rows, why rows were skipped, and months outside of 1 to 12, which are kept."""
    out = None
    for sheet, raw in sheets.items():
        no_id = clean_int(cell("acc_id")).isNull()
        no_date = ~no_id & clean_date(cell("payment_date")).isNull() if sheet == "Backend_payment" else F.lit(False)
        odd = ~no_id & ~F.coalesce(clean_int(cell("month")).between(1, 12), F.lit(False)) if sheet in USAGE_SHEETS else F.lit(False)
        one = raw.agg(F.lit(sheet).alias("sheet"), F.count("*").alias("raw"), F.count_if(~no_id & ~no_date).alias("clean"), F.count_if(no_id).alias("no_account"), F.count_if(no_date).alias("no_date"), F.count_if(odd).alias("odd_months"))
        out = one if out is None else out.unionByName(one)
    return out


def new_sources(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files (name, content) whose SHA-256 the catalog (checksum) does not have yet."""
    return files.withColumn("checksum", F.sha2("content", 256)).join(catalog.select("checksum"), "checksum", "left_anti")

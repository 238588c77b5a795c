"""Generated inputs for queries whose subject the tables do not hold; the same SQL runs on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"
CONTRACT = f"""concat(
  'Agreement no: AG-', cast(o_orderkey as string), '/', cast(o_custkey % 97 as string), {_NL},
  case o_orderkey % 4 when 0 then concat('Due Date: ', cast(cast(o_orderdate as date) as string), {_NL}) when 1 then concat('Payment due March 31, 2026', {_NL}) when 2 then concat('due by next friday noon;', {_NL}) else '' end,
  case o_orderkey % 5 when 0 then concat('Dated: ', cast(cast(o_orderdate as date) as string), '. ') when 1 then 'Made this 3 day. ' else '' end,
  'Total USD ', cast(o_orderkey % 1000 as string), ',000.50 and $', cast(o_orderkey % 10 as string), ' then $', cast(o_custkey as string), '.00 again $', cast(o_custkey as string), '.00 or 12,34,567 ',
  case o_orderkey % 3 when 0 then 'plus 35 million dollars. ' when 1 then 'plus 2 lakh rupees. ' else 'usd 500 now. ' end,
  case o_orderkey % 6 when 0 then 'Rupees Five Lakh Only. ' when 1 then 'Dollars two hundred. ' else '' end,
  case o_orderkey % 4 when 0 then 'Less: 50.25 net' when 1 then 'Discount $15 given' when 2 then 'less: 7 x' else 'TDS 1,200' end, {_NL},
  case o_orderkey % 5 when 0 then 'Signed by John Smith' when 1 then 'Signed by: Mary Ann Jones' when 2 then 'duly authorized 7' else 'Witnessed by Alan Turing' end, {_NL},
  case o_orderkey % 3 when 0 then concat('Buyer: Orion', cast(o_custkey % 9 as string), ' Holdings, and') else concat('with Vega ', cast(o_custkey % 11 as string), ' Solutions now') end, {_NL},
  case o_orderkey % 7 when 0 then 'The third day of March, 2024' when 1 then 'twenty-first day of June' else '' end, {_NL},
  'Invoice # INV-', cast(o_orderkey % 10000 as string), ' order no ab ref number 9x. ',
  'On 12/05/2024 and 2024-06-01, 12/05/2024, Jan 5, 2023 ', cast(cast(o_orderdate as date) as string), ' end.', {_NL},
  'Payment due in 30 days', case o_orderkey % 3 when 0 then ' or within 45 days' when 1 then ' or within 30 days' else '' end, '. ',
  'Termination with ', cast(30 + 30 * (o_orderkey % 2) as string), ' days; notice of 60 months. ',
  case o_custkey % 4 when 0 then 'Fees are non-refundable. ' when 1 then 'Fees are refundable. ' when 2 then 'Fees are non-refundable and refundable. ' else '' end,
  case o_custkey % 3 when 0 then 'A non-exclusive license. ' when 1 then 'An exclusive license. ' else '' end)"""
NOISY = f"""concat(
  'ﬁrst  line of ', c_name, '   ﬂat “quoted” ‘text’', {_NL}, 'hyphen-', {_NL}, '   ated word-', chr(13), {_NL}, 'next  ', {_NL}, {_NL}, {_NL}, {_NL},
  'Øne • · ● – — ◦ eﬃcient baﬄe', {_NL}, '1O0 and $O5 but 1OO0', cast(c_custkey as string), ' 2l3 wo|rd a |b', {_NL}, '%%%%%%', {_NL}, '#1', {_NL}, 'tail   ', chr(12), 'a   b  c  d', {_NL}, '***', {_NL}, '«end» `q´')"""
PAGE = f"""concat(
  case when c_custkey % 3 < 2 or page_no % 2 = 0 then concat('Report ', cast(c_custkey % 7 as string)) else concat('Part ', cast(page_no as string)) end,
  case when c_custkey % 11 = 0 and page_no = 2 then '' else concat({_NL}, 'Line of ', c_name, ' on page ', cast(page_no as string), ' which is long enough for a native page', {_NL}, case when page_no = 3 then concat('Report ', cast(c_custkey % 7 as string)) else 'middle' end) end,
  case when c_custkey % 5 = 0 then '' else concat({_NL}, 'Footer ', case when page_no % 3 = 0 then 'x' else 'all' end) end)"""
PIXEL = "case img_id % 5 when 0 then (x * 7 + y * 13 + img_id * 31) % 256 when 1 then (x * y * 11 + img_id) % 256 when 2 then 200 + (x + y) % 55 when 3 then case when y % 4 = 0 then 10 else 240 end else 77 end"
SIDE, WIDE_SIDE, SHEET_HEIGHT, SHEET_WIDTH = 16, 96, 56, 72
SHEET = "case when img_id % 13 = 0 then 255 when (y * 1000 + x * (img_id % 25 - 12) * 10 + 100000) % 12000 < 3000 then 20 + x % 7 else 230 + y % 20 end"
#: Pages with their own text, what an engine would read in two modes, the skew, and whether the page was lost.
SCAN = f"""doc_id, page_no,
  case when doc_id % 4 = 0 then text when doc_id % 4 = 1 then '' when (doc_id + page_no) % 2 = 0 then text else 'short' end AS native,
  case when (doc_id + page_no) % 4 = 0 then '%%## ~~ @@ ^^ && ** <<>> == ||' else concat('Scan head ', cast(doc_id % 3 as string), {_NL}, {_NL}, 'page ', cast(page_no as string), ' of the scan has  2l3 marks and 1O0 words enough', {_NL}, 'Scan foot') end AS block,
  case (doc_id + page_no) % 8 when 0 then concat('Better layout read on page ', cast(page_no as string), ' by the other mode') when 4 then '## @@' else '' end AS layout,
  cast((doc_id * 7 + page_no * 3) % 51 - 25 as double) / 10 AS skew, doc_id % 13 = 0 AND page_no = 2 AS failed"""
#: Sheets of sixteen bars that spell a number, thick ones for set bits: 40 pixels wide and 136 high, by page and supplier.
BARS_HEIGHT, BARS_WIDTH = 136, 40
_BAR = "case when shiftright(sheet, i) % 2 = 1 then concat(repeat('14', 200), repeat('EB', 120)) else concat(repeat('14', 80), repeat('EB', 240)) end"
BARS = f"unhex(concat(repeat('EB', 160), array_join(transform(sequence(0, 15), i -> {_BAR}), ''), repeat('EB', 160)))"
OWN = "case when s_suppkey % 6 = 0 or (s_suppkey % 3 = 0 and page_no = 2) then concat('The file ', s_name, ' holds on page ', cast(page_no as string), ' a text of its own that needs no reading') when page_no = 3 then 'too short' end"
FILE = "case c_custkey % 9 when 0 then '255044462D312E37' when 1 then '89504E470D0A1A0A' when 2 then 'FFD8FFE0' when 3 then '49492A00FF' when 4 then '4D4D002AFF' when 5 then '424D' when 6 then '00' when 7 then '' else 'CAFEBABE00' end"
DECLARED = "case c_custkey % 3 when 0 then 'application/pdf' when 1 then 'image/png' end"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Pixels made of rows that one task takes, and what a contract, a customer's pages and a supplier's sheets cost in pixels.
TASK_PIXELS, CONTRACT_COST, PAGES_COST, SHEETS_COST = 1 << 22, 256, 128, 4 * BARS_HEIGHT * BARS_WIDTH


def dealt(rows: DataFrame, key: str, cost: int) -> DataFrame:
    """Rows dealt out by a key before much is made of each: a table of few bytes would be one task, however much comes of it.

    The number of tasks grows with the table, so what one task makes does not.  Of a key's rows nothing is shuffled again.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * cost // TASK_PIXELS))
    return rows.repartition(tasks, key)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return dealt(orders, "o_orderkey", CONTRACT_COST).selectExpr("o_orderkey AS doc_id", f"{CONTRACT} AS text")


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{NOISY} AS text")


def page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = dealt(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", PAGES_COST)
    pages = customers.selectExpr("c_custkey", "c_name", "explode(sequence(1, 1 + cast(c_custkey % 5 AS int))) AS page_no")
    return pages.selectExpr("c_custkey AS doc_id", "page_no", f"{PAGE} AS text")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_sets(spark, sf_dir).selectExpr(*[x.strip() for x in _split(SCAN)])


def bar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rasters for each supplier: some with a text of their own, some damaged."""
    suppliers = dealt(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", SHEETS_COST)
    pages = suppliers.selectExpr("s_suppkey", "s_name", "explode(sequence(1, 1 + cast(s_suppkey % 4 AS int))) AS page_no")
    pages = pages.selectExpr("s_suppkey AS doc_id", "page_no", f"{OWN} AS native", "cast((s_suppkey * 8 + page_no) % 65536 AS int) AS sheet")
    damaged = "doc_id % 13 = 1 AND page_no = 2"
    return pages.selectExpr("doc_id", "page_no", "native", f"if({damaged}, -1, {BARS_HEIGHT}) AS height", f"{BARS_WIDTH} AS width", "1 AS nChannels", f"{BARS} AS data")


def _split(columns: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _grid(ids: DataFrame, height: int, width: int, value: str, made: int = 1) -> DataFrame:
    rows = dealt(ids, "img_id", height * width * made).selectExpr("img_id", f"explode(sequence(0, {height - 1})) AS y").selectExpr("img_id", "y", f"explode(sequence(0, {width - 1})) AS x")
    return rows.selectExpr("img_id", "y", "x", f"cast({value} AS int) AS v")


def wide_pixels(spark: SparkSession, sf_dir: str, made: int = 1) -> DataFrame:
    """An image of 96 x 96 for each supplier, larger than the local threshold's reach each way; ``made``: see ``pixels``."""
    return _grid(_read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey AS int) AS img_id"), WIDE_SIDE, WIDE_SIDE, PIXEL, made)


def pixels(spark: SparkSession, sf_dir: str, made: int = 1) -> DataFrame:
    """An image of 16 x 16 for each customer; ``made``: how many rows come of a pixel at most, which tasks are sized by."""
    return _grid(_read(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS int) AS img_id"), SIDE, SIDE, PIXEL, made)


def sheets(spark: SparkSession, sf_dir: str, made: int = 1) -> DataFrame:
    """A sheet of slanted lines for each supplier, some blank."""
    return _grid(_read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey AS int) AS img_id"), SHEET_HEIGHT, SHEET_WIDTH, SHEET, made)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(_read(spark, sf_dir, "customer"))


def as_files(customers: DataFrame) -> DataFrame:
    return customers.selectExpr("cast(c_custkey AS string) AS doc_id", f"unhex({FILE}) AS content", f"{DECLARED} AS declared")


def _grid_sql(name: str, key: str, table: str, height: int, width: int, value: str) -> str:
    return f"{name} AS (SELECT img_id, y, x, ({value})::INT AS v FROM (SELECT {key}::INT AS img_id, a.i::INT AS y, b.i::INT AS x FROM {table}, range({height}) a(i), range({width}) b(i)))"


#: The same inputs as DuckDB table expressions.
SQL = {
    "contracts": f"contracts AS (SELECT o_orderkey AS doc_id, {CONTRACT} AS text FROM orders)",
    "noisy": f"noisy AS (SELECT c_custkey AS id, {NOISY} AS text FROM customer)",
    "page_sets": f"page_sets AS (SELECT c_custkey AS doc_id, page_no::INT AS page_no, {PAGE} AS text FROM (SELECT c_custkey, c_name, unnest(generate_series(1, 1 + c_custkey % 5)) AS page_no FROM customer))",
    "pixels": _grid_sql("pixels", "c_custkey", "customer", SIDE, SIDE, PIXEL),
    "scans": f"scans AS (SELECT {SCAN} FROM page_sets)",
    "wide_pixels": _grid_sql("wide_pixels", "s_suppkey", "supplier", WIDE_SIDE, WIDE_SIDE, PIXEL),
    "sheets": _grid_sql("sheets", "s_suppkey", "supplier", SHEET_HEIGHT, SHEET_WIDTH, SHEET),
    "bar_pages": f"bar_pages AS (SELECT s_suppkey AS doc_id, page_no::INT AS page_no, {OWN} AS native, (s_suppkey * 8 + page_no) % 65536 AS sheet FROM (SELECT s_suppkey, s_name, unnest(generate_series(1, 1 + s_suppkey % 4)) AS page_no FROM supplier))",
    "files": f"files AS (SELECT c_custkey::VARCHAR AS doc_id, unhex({FILE}) AS content, {DECLARED} AS declared FROM customer)",
}

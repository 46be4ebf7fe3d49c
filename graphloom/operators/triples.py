"""Rows of tables as triples with provenance, and the resolution of keys to names.

A triple's `seq` (section, row key, rule) is its place in the order in which the tables are read;
it decides which of equal triples stays, whatever the partitioning. Where row keys are whole numbers
the three are packed in one long, of which the least is found in a hash aggregate; else they are a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import money, strip

SOURCE = "structured_csv"
#: Rules of a section, and whole row keys, lie below these.
RULES, ROWS = 10, 10**16


class Rule:
    """subject -[relationship]-> object; rows where `when` fails or either end is null or blank give nothing."""

    def __init__(self, subject: Column, relationship: str, obj: Column, subject_type: str = "Entity", object_type: str = "Entity", when: Column | None = None):
        self.subject, self.relationship, self.obj, self.types, self.when = subject, relationship, obj, (subject_type, object_type), when


def unpivot(rows: DataFrame, rules: list[Rule], key: Column, section: int = 0, source: str | Column = SOURCE, by: str | None = None) -> DataFrame:
    """All triples of the rules in one pass over rows. A whole key is at least 0 and below ROWS; a null one comes first.

    by: a column that stays as _by, where rows are dealt by it and equal triples always have the same.
    """
    src = F.lit(source) if isinstance(source, str) else source
    whole, cells = rows.select(key).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint"), []
    if whole and len(rules) > RULES:
        raise ValueError(f"a section has at most {RULES} rules")
    for i, r in enumerate(rules):
        seq = F.lit(section * RULES * ROWS + i) + (F.coalesce(key.cast("long"), F.lit(0)) * RULES) if whole else F.struct(F.lit(section).alias("section"), key.cast("string").alias("row"), F.lit(i).alias("rule"))
        obj = strip(r.obj.cast("string"))
        cells.append(
            F.struct(
                strip(r.subject.cast("string")).alias("subject"), F.lit(r.relationship).alias("relationship"), (obj if r.when is None else F.when(r.when, obj)).alias("object"), F.lit(r.types[0]).alias("subject_type"), F.lit(r.types[1]).alias("object_type"),
                src.alias("source"), F.lit(None).cast("long").alias("page_number"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("string").alias("section"), seq.alias("seq"),
            )
        )
    return rows.select(*([] if by is None else [F.col(by).alias("_by")]), F.inline(F.array(*cells))).filter("subject <> '' and object <> ''")


def lookup(rows: DataFrame, key: str, names: DataFrame, out: str, unique: bool = False) -> DataFrame:
    """rows with `out`: the name that names (id, name) has for rows' key; an unknown or null key gives ''.

    Of several names of an id the largest is taken. unique: the caller knows that ids don't repeat,
    so that names aren't shuffled to find out.
    """
    one = names.select(F.col("id").alias("_id"), F.col("name").alias("_name")) if unique else names.groupBy(F.col("id").alias("_id")).agg(F.max("name").alias("_name"))
    return rows.join(one, rows[key] == one["_id"], "left").withColumn(out, F.coalesce("_name", F.lit(""))).drop("_id", "_name")


def distinct_triples(triples: DataFrame) -> DataFrame:
    """One row per (subject, relationship, object), the first by seq."""
    return first_of(triples, ("subject", "relationship", "object"), "seq", "source")


def first_of(rows: DataFrame, key: tuple[str, ...], *order: str) -> DataFrame:
    """One row per key, the first by order. A hash of the key leads the sort, so that texts are compared only where it is equal.

    Rows are dealt by it before they are sorted: the tasks that make them may go by much smaller rows.
    """
    first = Window.partitionBy("_hash", *key).orderBy(*order)
    return rows.withColumn("_hash", F.xxhash64(*key)).repartition("_hash").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_hash", "_n")


def business_triples(t: dict[str, DataFrame]) -> DataFrame:
    """Distinct triples of the eight business tables; absent tables are empty ones.

    Orders give triples only if both their customer and employee are known, items only if their
    product and order are. Cancelled orders count as any other.
    """
    company = t["company"].agg(F.min_by("name", "id").alias("company")).select(F.coalesce("company", F.lit("Company")).alias("company"))
    names = {n: t[n].select("id", "name") for n in ("departments", "regions", "products", "employees", "customers")}
    c = F.col
    out = [
        unpivot(t["company"], [Rule(c("name"), "IS_A", c("industry"), "Organization", "Concept"), Rule(c("name"), "FOUNDED_IN", c("founded_year").cast("long"), "Organization", "Concept")], c("id"), 0),
        unpivot(t["departments"].join(F.broadcast(company)), [Rule(c("name"), "IS_A", F.lit("Department"), "Organization", "Concept"), Rule(c("name"), "PART_OF", c("company"), "Organization", "Organization")], c("id"), 1),
        unpivot(t["regions"], [Rule(c("name"), "IS_A", F.lit("Region"), "Location", "Concept")], c("id"), 2),
        unpivot(t["products"], [Rule(c("name"), "IS_A", c("category"), "Topic", "Concept"), Rule(c("name"), "PRICED_AT", money(c("price")), "Topic", "Measurement")], c("id"), 3),
    ]
    staff = lookup(lookup(t["employees"], "department_id", names["departments"], "department"), "manager_id", names["employees"], "manager").join(F.broadcast(company))
    out.append(unpivot(staff, [
        Rule(c("name"), "IS_A", F.lit("Employee"), "Person", "Concept"), Rule(c("name"), "HAS_ROLE", c("job_title"), "Person", "Concept"), Rule(c("name"), "EMPLOYED_BY", c("company"), "Person", "Organization"),
        Rule(c("name"), "WORKS_IN", c("department"), "Person", "Organization"), Rule(c("name"), "REPORTS_TO", c("manager"), "Person", "Person"), Rule(c("name"), "HIRED_ON", c("hire_date"), "Person", "Event"),
    ], c("id"), 4))
    clients = lookup(t["customers"], "region_id", names["regions"], "region")
    out.append(unpivot(clients, [
        Rule(c("name"), "IS_A", F.lit("Customer"), "Organization", "Concept"), Rule(c("name"), "REPRESENTS", c("company_name"), "Organization", "Organization"), Rule(c("name"), "LOCATED_IN", c("region"), "Organization", "Location"), Rule(c("name"), "CUSTOMER_SINCE", c("customer_since"), "Organization", "Event"),
    ], c("id"), 5))
    orders = lookup(lookup(t["orders"], "customer_id", names["customers"], "customer"), "employee_id", names["employees"], "employee")
    known = (c("customer") != "") & (c("employee") != "")
    out.append(unpivot(orders, [Rule(c("employee"), "SOLD_TO", c("customer"), "Person", "Organization", known), Rule(c("customer"), "ORDER_WORTH", money(c("total_amount")), "Organization", "Measurement", known)], c("id"), 6))
    items = lookup(t["order_items"], "product_id", names["products"], "product").filter("product <> ''").join(orders.select(c("id").alias("order_id"), "customer", "employee"), "order_id")
    out.append(unpivot(items, [
        Rule(c("customer"), "PURCHASED", c("product"), "Organization", "Topic"), Rule(c("employee"), "SOLD", c("product"), "Person", "Topic"), Rule(c("product"), "ORDERED_QTY", c("quantity").cast("long"), "Topic", "Measurement", c("quantity") > 1),
    ], c("id"), 7))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return distinct_triples(every)


def linearise(rows: DataFrame, table: str, names: DataFrame | None = None, order: str = "id") -> DataFrame:
    """One text per row, `table: column=value | ...`, nulls left out.

    A value of a column that ends in `_id` is followed by its name in brackets if names (id, name),
    a map over all tables, has it. Doubles are written without exponent.
    """
    kinds, parts = dict(rows.dtypes), []
    found = rows
    for i, col in enumerate(x for x in rows.columns if x.endswith("_id") and names is not None):
        one = names.groupBy(F.col("id").alias(f"_id{i}")).agg(F.max("name").alias(f"_name_{col}"))
        found = found.join(one, F.col(col).cast("string") == F.col(f"_id{i}").cast("string"), "left").drop(f"_id{i}")
    for col in rows.columns:
        value = F.col(col).cast("string")
        if kinds[col] in ("double", "float"):
            value = F.regexp_replace(F.format_string("%.6f", F.col(col)), r"\.?0+$", "")
        elif kinds[col] == "boolean":
            value = F.initcap(value)
        shown = F.concat(F.lit(f"{col}="), value)
        if f"_name_{col}" in found.columns:
            shown = F.when(F.col(f"_name_{col}").isNotNull(), F.concat(shown, F.lit(" ("), F.col(f"_name_{col}"), F.lit(")"))).otherwise(shown)
        parts.append(F.when(F.col(col).isNotNull(), shown))
    text = F.concat(F.lit(f"{table}: "), F.array_join(F.array_compact(F.array(*parts)), " | "))
    return found.select(F.col(order).alias("row_key"), text.alias("text"))


def star_triples(t: dict[str, DataFrame], dealt: bool = False) -> dict[str, DataFrame]:
    """The same rules over a star schema of customers, parts, suppliers, orders and line items, by section; not yet distinct. Keys of customers, nations and suppliers are unique.

    dealt: an item's triples lie with the others of its part, which is an end of each, and have its key as
    _by: their edges can be merged there, and the item's row is shuffled once, in place of its triples.
    """
    c = F.col
    nations = t["nation"].select(c("n_nationkey").alias("id"), c("n_name").alias("name"))
    part = F.concat(F.lit("Part#"), c("p_partkey").cast("string"))
    customers = lookup(t["customer"], "c_nationkey", nations, "nation", True)
    out = {
        "customer": unpivot(customers, [Rule(c("c_name"), "IS_A", F.lit("Customer"), "Organization", "Concept"), Rule(c("c_name"), "IN_SEGMENT", c("c_mktsegment"), "Organization", "Concept"), Rule(c("c_name"), "LOCATED_IN", c("nation"), "Organization", "Location")], c("c_custkey"), 0, "customer"),
        "part": unpivot(t["part"], [Rule(part, "IS_A", c("p_type"), "Topic", "Concept"), Rule(part, "NAMED", c("p_name"), "Topic", "Concept"), Rule(part, "PRICED_AT", money(c("p_retailprice")), "Topic", "Measurement")], c("p_partkey"), 1, "part"),
    }
    clients = t["customer"].select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    orders = lookup(t["orders"].select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", clients, "customer", True)
    out["orders"] = unpivot(orders, [Rule(c("customer"), "ORDER_WORTH", money(c("o_totalprice")), "Organization", "Measurement")], c("o_orderkey"), 2, "orders")
    sellers = t["supplier"].select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    items = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").join(orders.select(c("o_orderkey").alias("l_orderkey"), "customer"), "l_orderkey")
    products = t["part"].select(c("p_partkey").alias("l_partkey"), part.alias("product"))
    items = lookup(items, "l_suppkey", sellers, "seller", True).join(products.hint("merge") if dealt else products, "l_partkey")
    key = c("l_orderkey") * 10000 + c("l_linenumber")
    out["lineitem"] = unpivot(items, [Rule(c("customer"), "PURCHASED", c("product"), "Organization", "Topic"), Rule(c("seller"), "SOLD", c("product"), "Person", "Topic"), Rule(c("product"), "ORDERED_QTY", c("l_quantity").cast("long"), "Topic", "Measurement", c("l_quantity") > 1)], key, 3, "lineitem", "l_partkey" if dealt else None)
    return out

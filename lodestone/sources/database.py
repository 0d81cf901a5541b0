"""Table schemas of a database as Markdown documents; no rows are read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.convert import column_type, shortened
from lodestone.operators.filters import allow_then_deny

Reader = Callable[[str], DataFrame]


#: Columns with their comments as PostgreSQL keeps them; other databases are given a query of their own.
COLUMNS_WITH_COMMENTS = (
    "select c.*, d.description as comment from information_schema.columns c"
    " left join pg_catalog.pg_namespace n on n.nspname = c.table_schema left join pg_catalog.pg_class t on t.relname = c.table_name and t.relnamespace = n.oid"
    " left join pg_catalog.pg_description d on d.objoid = t.oid and d.objsubid = c.ordinal_position"
)
COLUMNS = "select c.*, cast(null as varchar) as comment from information_schema.columns c"


def jdbc_reader(spark: SparkSession, url: str, **options: str) -> Reader:
    return lambda query: spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def catalog_columns(spark: SparkSession, database: str) -> DataFrame:
    """Spark's own tables in the shape of information_schema.columns."""
    rows = []
    for t in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"), 1):
            rows.append((database, t.name, c.name, i, c.dataType, "YES" if c.nullable else "NO"))
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def schema_markdown(tables: DataFrame, columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """(table_schema, table_name, markdown): columns, constraints and relationships of each table.

    ``columns``: as information_schema, with comment; ``constraints``: constraint_type, constraint_name, column_name,
    foreign_table_name, foreign_column_name, check_clause, ordinal.
    """
    key = ["table_schema", "table_name"]
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    kind = column_type(F.col("data_type"), F.col("udt_name"), F.col("character_maximum_length"), F.col("numeric_precision"), F.col("numeric_scale"))
    line = F.concat(F.lit("| "), tick(F.col("column_name")), F.lit(" | "), tick(kind), F.lit(" | "), F.col("is_nullable"), F.lit(" | "), F.coalesce(shortened(F.col("column_default")), F.lit("")), F.lit(" | "), F.coalesce("comment", F.lit("")), F.lit(" |"))
    listed = columns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal_position", line.alias("x")))).alias("c")).select(*key, F.array_join("c.x", "\n").alias("columns"))
    grouped = constraints.groupBy(*key, "constraint_type", F.when(F.col("constraint_type") == "PRIMARY KEY", "").otherwise(F.col("constraint_name")).alias("name")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "foreign_table_name", "foreign_column_name", "check_clause"))).alias("p")
    )
    names = F.array_join(F.transform("p.column_name", tick), ", ")
    head = F.element_at("p", 1)
    arrow = F.concat(tick(head["column_name"]), F.lit(" → "), tick(head["foreign_table_name"]), F.lit("."), tick(head["foreign_column_name"]))
    text = (
        F.when(F.col("constraint_type") == "PRIMARY KEY", F.concat(F.lit("- **Primary Key**: "), names))
        .when(F.col("constraint_type") == "UNIQUE", F.concat(F.lit("- **Unique** ("), tick(F.col("name")), F.lit("): "), names))
        .when(F.col("constraint_type") == "FOREIGN KEY", F.concat(F.lit("- **Foreign Key** ("), tick(F.col("name")), F.lit("): "), arrow))
        .when(F.col("constraint_type") == "CHECK", F.concat(F.lit("- **Check** ("), tick(F.col("name")), F.lit("): "), tick(head["check_clause"])))
    )
    order = F.when(F.col("constraint_type") == "PRIMARY KEY", 1).when(F.col("constraint_type") == "UNIQUE", 2).when(F.col("constraint_type") == "FOREIGN KEY", 3).otherwise(4)
    relation = F.when(F.col("constraint_type") == "FOREIGN KEY", F.concat(F.lit("- "), tick(F.col("table_name")), F.lit("."), tick(head["column_name"]), F.lit(" references "), tick(head["foreign_table_name"]), F.lit("."), tick(head["foreign_column_name"])))
    rules = grouped.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "name", text.alias("x")))).alias("r"), F.sort_array(F.collect_list(relation)).alias("rel"))
    rules = rules.select(*key, F.array_join("r.x", "\n").alias("constraints"), F.array_join("rel", "\n").alias("relations"))
    both = tables.join(listed, key, "left").join(rules, key, "left")
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Table: "), tick(F.concat("table_schema", F.lit("."), "table_name"))),
        F.concat(F.lit("## Columns\n\n| Column | Type | Nullable | Default | Comment |\n| --- | --- | --- | --- | --- |\n"), F.coalesce("columns", F.lit(""))),
        F.when(F.col("constraints") != "", F.concat(F.lit("## Constraints\n\n"), "constraints")),
        F.when(F.col("relations") != "", F.concat(F.lit("## Relationships\n\n"), "relations")),
    )
    return both.select(*key, F.concat(body, F.lit("\n")).alias("markdown"))


class DatabaseConnector:
    """``read`` runs a query on the database (for example :func:`jdbc_reader`)."""

    def __init__(self, read: Reader, schemas: Sequence[str] = ("public",), include: Sequence[str] = (), exclude: Sequence[str] = (), include_views: bool = True, columns_query: str = COLUMNS_WITH_COMMENTS):
        self.columns_query = columns_query
        self.read, self.schemas, self.include, self.exclude, self.views = read, schemas, include, exclude, include_views

    def validate(self, spark: SparkSession) -> None:
        self.read("select 1 as ok").first()

    def _tables(self) -> DataFrame:
        t = self.read("select table_schema, table_name, table_type from information_schema.tables")
        kinds = ["BASE TABLE", "VIEW"] if self.views else ["BASE TABLE"]
        return t.where(F.col("table_schema").isin(*self.schemas) & F.col("table_type").isin(*kinds) & allow_then_deny("table_name", self.include, self.exclude))

    def discover(self, spark: SparkSession) -> DataFrame:
        name = F.concat("table_schema", F.lit("."), "table_name")
        return self._tables().select(F.sha1(name).alias("external_id"), F.concat(F.lit("db://"), "table_schema", F.lit("/"), "table_name").alias("uri"), F.lit(None).cast("timestamp").alias("updated_at"), F.create_map(F.lit("schema"), F.col("table_schema"), F.lit("table"), F.col("table_name"), F.lit("table_type"), F.col("table_type")).alias("metadata"))

    def fetch(self, spark: SparkSession, refs: DataFrame | None = None) -> DataFrame:
        columns = self.read(self.columns_query)
        constraints = self.read(
            "select t.table_schema, t.table_name, t.constraint_type, t.constraint_name, k.column_name, u.table_name as foreign_table_name, u.column_name as foreign_column_name, c.check_clause, k.ordinal_position as ordinal"
            " from information_schema.table_constraints t left join information_schema.key_column_usage k on t.constraint_schema = k.constraint_schema and t.constraint_name = k.constraint_name and t.table_name = k.table_name"
            " left join information_schema.constraint_column_usage u on t.constraint_type = 'FOREIGN KEY' and t.constraint_schema = u.constraint_schema and t.constraint_name = u.constraint_name"
            " left join information_schema.check_constraints c on t.constraint_schema = c.constraint_schema and t.constraint_name = c.constraint_name"
        )
        m = schema_markdown(self._tables(), columns, constraints)
        out = m.select(F.sha1(F.concat("table_schema", F.lit("."), "table_name")).alias("external_id"), F.concat(F.lit("db://"), "table_schema", F.lit("/"), "table_name").alias("uri"), F.lit("text/markdown").alias("content_type"), F.encode("markdown", "UTF-8").alias("content"))
        return out if refs is None else out.join(refs.select("external_id"), "external_id", "left_semi")

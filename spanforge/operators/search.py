"""Searching: order, pages, totals, keyword-in-context and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.model import DOCUMENT_PRIVILEGED, Catalog
from spanforge.operators.location import SPAN
from spanforge.plans.compiler import Options, compile_query
from spanforge.plans.parser import parse_batch

PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
TIE = ("document_id", "p1", "p2", "id")


def with_documents(spans: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds author, title and sort_key of the documents."""
    d = catalog.document.select(F.col("id").alias("document_id"), "author", "title", "sort_key")
    return spans.join(d, "document_id").select(*spans.columns, "author", "title", "sort_key")


def sorted_results(results: DataFrame, catalog: Catalog, fields: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """The results with what the order needs, and the order: [+-]field of a result, reversed_value, a field of the document or
    the name of one of its attributes.  By default value, sort_key and p1."""
    order: list[Column] = []
    for k, f in enumerate(fields or ("value", "sort_key", "p1")):
        down, name = f.startswith("-"), f.lstrip("+-")
        if name == "reversed_value":
            column = F.reverse("value")
        elif name in results.columns:
            column = F.col(name)
        elif name in DOCUMENT_PRIVILEGED:
            own = catalog.document.select(F.col("id").alias("document_id"), F.col(name).alias(f"__s{k}"))
            results, column = results.join(own, "document_id", "left"), F.col(f"__s{k}")
        else:
            own = catalog.document_attribute.filter(F.lower("name") == name.lower()).groupBy("document_id").agg(F.min("value").alias(f"__s{k}"))
            results, column = results.join(own, "document_id", "left"), F.col(f"__s{k}")
        order.append(column.desc_nulls_last() if down else column.asc_nulls_last())
    return results, order + [F.col(c).asc() for c in TIE]


def search(
    catalog: Catalog, query: str, page: int = 1, size: int = PAGE_SIZE, sort: tuple[str, ...] = (), options: Options = Options()
) -> tuple[DataFrame, int]:
    """A page of results (a top-k over all, not a sort of all) and the total."""
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"pages count from 1 and have 1 to {MAX_PAGE_SIZE} results")
    found = compile_query(catalog, query, options)
    return search_page(catalog, found, page, size, sort), found.count()


def search_page(catalog: Catalog, found: DataFrame, page: int = 1, size: int = PAGE_SIZE, sort: tuple[str, ...] = ()) -> DataFrame:
    results = with_documents(found, catalog)
    columns = results.columns
    keyed, order = sorted_results(results, catalog, sort)
    return keyed.orderBy(*order).limit(page * size).offset((page - 1) * size).select(*columns)


def kwic(results: DataFrame, catalog: Catalog, size: int = 5) -> DataFrame:
    """Adds left and right, arrays of `size` values before p1 and after p2, with empty values where the document ends.

    Each result asks for 2 * size positions and finds them by an equi join on (document, position), so neither long documents nor
    many results lead to a join over ranges."""
    if size < 1:
        raise ValueError("a context has at least one token")
    columns = results.columns
    offsets = F.array(*(F.lit(k) for k in [*range(-size, 0), *range(1, size + 1)]))
    place = F.when(F.col("__k") < 0, F.col("p1") + F.col("__k")).otherwise(F.col("p2") + F.col("__k"))
    asked = results.select("id", "document_id", "p1", "p2", F.explode(offsets).alias("__k")).select("id", "document_id", "__k", place.alias("__p"))
    tokens = catalog.span.filter("type = 'tok'").select("document_id", F.col("p1").alias("__p"), F.col("value").alias("__v"))
    found = asked.join(tokens, ["document_id", "__p"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__m"))

    def side(ks: range) -> Column:
        return F.array(*(F.coalesce(F.try_element_at("__m", F.lit(k)), F.lit("")) for k in ks))

    return results.join(found, "id", "left").select(*columns, side(range(-size, 0)).alias("left"), side(range(1, size + 1)).alias("right"))


def flat_kwic(contexts: DataFrame, size: int) -> DataFrame:
    """One column for each place: c_5 ... c_1 before, value, c1 ... c5 after."""
    left = [F.col("left")[k].alias(f"c_{size - k}") for k in range(size)]
    right = [F.col("right")[k].alias(f"c{k + 1}") for k in range(size)]
    rest = [c for c in contexts.columns if c not in ("left", "right", "value")]
    before = [c for c in rest if c in SPAN]
    return contexts.select(*before, *left, "value", *right, *(c for c in rest if c not in SPAN))


def export_kwic(
    catalog: Catalog, query: str, path: str, context: int = 5, rows_per_file: int = 0, sort: tuple[str, ...] = (), options: Options = Options(),
    first_page: int = 1, last_page: int = 0, size: int = PAGE_SIZE,
) -> None:
    """The results of a query with their contexts as CSV files, in order; pages first_page to last_page (0: all)."""
    results = with_documents(compile_query(catalog, query, options), catalog)
    if last_page:
        columns = results.columns
        keyed, order = sorted_results(results, catalog, sort)
        results = keyed.orderBy(*order).limit(last_page * size).offset((first_page - 1) * size).select(*columns)
    flat = flat_kwic(kwic(results, catalog, context), context)
    keyed, order = sorted_results(flat, catalog, sort)
    ordered = keyed.orderBy(*order)
    if first_page > 1 and not last_page:
        ordered = ordered.offset((first_page - 1) * size)
    out = ordered.select(*flat.columns)
    out.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def export_batch(catalog: Catalog, text: str, folder: str, **how) -> list[tuple[str, str]]:
    """Exports the queries of a file, each to a folder of its own; (query, its folder) of all.  how: as for `export_kwic`."""
    out = [(q, f"{folder}/query-{k:04d}") for k, q in enumerate(parse_batch(text), 1)]
    for query, path in out:
        export_kwic(catalog, query, path, **how)
    return out

"""C1–C4 — per-tenant context documents and conversation history.

Documents are produced for all tenants in one job, in *long form*: one row per output
line with its position ``(company_id, section_order, line_key)``.  Concatenating the
lines of a tenant in that order (sections separated by a blank line) gives the
document text.  Nothing is gathered per tenant: list sections are plain projections,
the two "15 newest" sections are per-tenant top-k (bounded), so a tenant holding a
third of all rows is spread over many tasks.  :func:`assemble_documents` builds the
text column where the sizes are known to be small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlens.functions.predicates import is_delayed_status, is_low_stock, is_open
from chainlens.operators.risks import risks_by_company
from chainlens.operators.slices import PLACE, SLICE, in_slices_summed
from chainlens.session import written

# Fixed section titles, in document order.
SECTIONS = [
    (1, "companies", "## Companies"),
    (2, "suppliers", "## Suppliers"),
    (3, "low_stock", "## Low Inventory Alerts"),
    (4, "orders", "## Recent Orders"),
    (5, "delayed", "## Delayed Shipments"),
    (6, "risks", "## Risk Events"),
    (7, "stats", "## Summary Stats (Your Company)"),
]
RECENT_N = 15
NO_DATA = "No data available."


def _s(c) -> Column:
    """Python's rendering of a value inside an f-string: NULL prints as 'None'."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit("None"))


def _line(section: str, df: DataFrame, key: Column, *parts) -> DataFrame:
    order, _, _ = next(s for s in SECTIONS if s[1] == section)
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return df.select("company_id", F.lit(order).alias("section_order"), F.lit(section).alias("section"),
                     key.cast("bigint").alias("line_key"), text.alias("line"))


def _tenant_suppliers(t) -> DataFrame:
    return t.supplier.select("supplier_id", "company_id", "supplier_name")


def _order_lines(o: DataFrame) -> DataFrame:
    return _line("orders", o, F.col("_rank"),
                 "- Order #", _s("order_id"), ": ", _s("product_name"), " x", _s("order_quantity"),
                 ", status: ", _s("order_status"), ", priority: ", _s("priority_level"), ", date: ",
                 _s("order_date"), ", company: ", _s("company_name"))


def _risk_lines(r: DataFrame) -> DataFrame:
    return _line("risks", r, F.col("_rank"),
                 "- Risk #", _s("risk_id"), ": ", _s("risk_type"), " (", _s("risk_severity"), ") on ",
                 _s("entity_type"), " #", _s("entity_id"), " — ", _s("description"), " [status: ",
                 _s("resolution_status"), ", detected: ", _s("detected_date"), "]")


def _tenant_lines(t, names) -> dict[str, DataFrame]:
    """Lines of the named sections, per tenant.  Fixed values: the line formats."""
    comp = t.company
    companies = _line("companies", comp, F.col("company_id"),
                      "- ", _s("company_name"), " (", _s("industry"), ", ", _s("country"), ")")

    cn = comp.select("company_id", "company_name")
    sup = t.supplier.join(cn, "company_id")
    pct = F.coalesce(F.col("reliability_score"), F.lit(0)) * 100
    suppliers = _line("suppliers", sup, F.col("supplier_id"),
                      "- ", _s("supplier_name"), " (", _s("country"), ") — reliability: ",
                      F.round(pct, 0).cast("bigint").cast("string"), "%, lead time: ",
                      _s("lead_time_days"), "d, company: ", _s("company_name"))

    p = t.product.select("product_id", "product_name", "supplier_id")
    w = t.warehouse.select("warehouse_id", "warehouse_name")
    low = (t.inventory.filter(is_low_stock()).join(p, "product_id").join(w, "warehouse_id")
           .join(_tenant_suppliers(t).select("supplier_id", "company_id"), "supplier_id"))
    low_stock = _line("low_stock", low, F.col("inventory_id"),
                      "- ", _s("product_name"), ": ", _s("quantity_available"), "/", _s("minimum_threshold"),
                      " units at ", _s("warehouse_name"), " (status: ", _s("inventory_status"), ")")

    pn = t.product.select("product_id", "product_name")
    w_o = Window.partitionBy("company_id").orderBy(F.col("order_date").desc_nulls_first(),
                                                   F.col("order_id").desc())
    o = (t.orders.join(pn, "product_id").join(cn, "company_id")
         .withColumn("_rank", F.row_number().over(w_o)).filter(F.col("_rank") <= RECENT_N))
    orders = _order_lines(o)

    sh = (t.shipment.filter(is_delayed_status()).join(pn, "product_id")
          .join(_tenant_suppliers(t), "supplier_id"))
    delayed = _line("delayed", sh, F.col("shipment_id"),
                    "- Shipment #", _s("shipment_id"), ": ", _s("product_name"), " from ", _s("supplier_name"),
                    ", expected: ", _s("expected_delivery_date"))

    w_r = Window.partitionBy("company_id").orderBy(F.col("detected_date").desc_nulls_first(),
                                                   F.col("risk_id").desc())
    r = risks_by_company(t).withColumn("_rank", F.row_number().over(w_r)).filter(F.col("_rank") <= RECENT_N)
    risks = _risk_lines(r)

    stats = context_stats(t)
    stats_lines = reduce(lambda a, b: a.unionByName(b), [
        _line("stats", stats, F.lit(1), "- Your Suppliers: ", _s("suppliers"), ", Your Products: ",
              _s("products")),
        _line("stats", stats, F.lit(2), "- Your Orders: ", _s("orders"), ", Your Shipments: ",
              _s("shipments"))])
    every = {"companies": companies, "suppliers": suppliers, "low_stock": low_stock, "orders": orders, "delayed": delayed,
             "risks": risks, "stats": stats_lines}
    return {n: every[n] for n in names}


def context_lines(t) -> DataFrame:
    """Body lines of the six list sections and the stats section, per tenant."""
    return reduce(lambda a, b: a.unionByName(b), _tenant_lines(t, [s for _, s, _ in SECTIONS]).values())


def context_stats(t) -> DataFrame:
    """A7 (tenant form): suppliers, products, orders, shipments per company.
    Facts are counted at the supplier grain before the tenant join."""
    s = t.supplier.select("supplier_id", "company_id")
    sup = s.groupBy("company_id").agg(F.count(F.lit(1)).alias("suppliers"))
    prod = (t.product.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")).join(s, "supplier_id")
            .groupBy("company_id").agg(F.sum("n").cast("bigint").alias("products")))
    ship = (t.shipment.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")).join(s, "supplier_id")
            .groupBy("company_id").agg(F.sum("n").cast("bigint").alias("shipments")))
    orders = t.orders.groupBy("company_id").agg(F.count(F.lit(1)).alias("orders"))
    x = reduce(lambda a, b: a.join(b, "company_id", "left"),
               [t.company.select("company_id"), sup, prod, orders, ship])
    return x.fillna(0, subset=["suppliers", "products", "orders", "shipments"])


GLOBAL_STATS_TITLE = "## Summary Stats (Global)"


def context_stats_global(t) -> DataFrame:
    """A7 (global form): one row of seven counts."""
    from chainlens.operators.kpis import count, single_row

    return single_row(t, companies=count(t.company), suppliers=count(t.supplier), products=count(t.product),
                      warehouses=count(t.warehouse), orders=count(t.orders), shipments=count(t.shipment),
                      open_risks=count(t.risk_event.filter(is_open())))


def context_lines_global(t) -> DataFrame:
    """C1 (admin form): the lines of all tenants, the 15 newest orders and risks of all, and the
    global stats block; ``company_id`` is NULL."""
    nobody = F.lit(None).cast("bigint").alias("company_id")
    same = _tenant_lines(t, ("companies", "suppliers", "low_stock", "delayed"))
    newest = t.orders.join(t.product.select("product_id", "product_name"), "product_id").join(
        t.company.select("company_id", "company_name"), "company_id")
    newest = newest.orderBy(F.col("order_date").desc_nulls_first(), F.col("order_id").desc()).limit(RECENT_N)
    rank = F.row_number().over(Window.orderBy(F.col("order_date").desc_nulls_first(), F.col("order_id").desc()))
    orders = _order_lines(newest.withColumn("_rank", rank))          # 15 rows
    latest = t.risk_event.orderBy(F.col("detected_date").desc_nulls_first(), F.col("risk_id").desc()).limit(RECENT_N)
    rank = F.row_number().over(Window.orderBy(F.col("detected_date").desc_nulls_first(), F.col("risk_id").desc()))
    risks = _risk_lines(latest.withColumn("_rank", rank).withColumn("company_id", F.lit(None).cast("bigint")))
    stats = context_stats_global(t).withColumn("company_id", F.lit(None).cast("bigint"))
    block = [
        _line("stats", stats, F.lit(1), "- Companies: ", _s("companies"), ", Suppliers: ", _s("suppliers"), ", Products: ",
              _s("products")),
        _line("stats", stats, F.lit(2), "- Warehouses: ", _s("warehouses"), ", Orders: ", _s("orders"), ", Shipments: ",
              _s("shipments")),
        _line("stats", stats, F.lit(3), "- Open/Investigating Risks: ", _s("open_risks"))]
    lines = reduce(lambda a, b: a.unionByName(b), [*same.values(), orders, risks, *block])
    return lines.select(nobody, "section_order", "section", "line_key", "line")


def context_document_global(t) -> DataFrame:
    """C2 (admin form): the one document over all tenants, as ordered lines."""
    titles = [(o, s, GLOBAL_STATS_TITLE if s == "stats" else title) for o, s, title in SECTIONS]
    return _document(t, context_lines_global(t), titles)


def context_document(t) -> DataFrame:
    """The full document per tenant as ordered lines: a title line per non-empty section
    (``line_key`` −1), before it a blank line unless it is the first (``line_key`` −2), and
    its body.  Tenants with no section get the single "No data available." line."""
    body, titles = context_lines(t), SECTIONS
    lines = _document(t, body, titles)
    empty = (t.company.select("company_id").join(lines.select("company_id").distinct(), "company_id", "left_anti")
             .select("company_id", F.lit(0).alias("section_order"), F.lit("none").alias("section"),
                     F.lit(0).cast("bigint").alias("line_key"), F.lit(NO_DATA).alias("line")))
    return lines.unionByName(empty)


def prompt_preamble(t) -> DataFrame:
    """C4's first turn per tenant as ordered lines: the heading, the tenant's document and the
    line that names the user's role and company (``section_order`` −1 and 99)."""
    def frame(order: int, section: str, key: int, line: Column) -> DataFrame:
        return t.company.select("company_id", F.lit(order).alias("section_order"), F.lit(section).alias("section"),
                                F.lit(key).cast("bigint").alias("line_key"), line.alias("line"))

    role = F.concat(F.lit("User's role: company, Company ID: "), F.col("company_id").cast("string"))
    return reduce(lambda a, b: a.unionByName(b), [
        frame(-1, "heading", 0, F.lit("# Live Database Context")), frame(-1, "heading", 1, F.lit("")), context_document(t),
        frame(99, "role", 0, F.lit("")), frame(99, "role", 1, F.lit("---")), frame(99, "role", 2, role)])


def _document(t, lines: DataFrame, titles) -> DataFrame:
    """Title and separator lines around ``lines``, which are written once and read three times."""
    body = written(t.spark, lines, "context")
    sections = t.spark.createDataFrame([tuple(x) for x in titles], "section_order int, section string, title string")
    present = body.groupBy("company_id", "section_order", "section").agg(F.count(F.lit(1)).alias("n")).drop("n")
    title_lines = present.join(sections, ["section_order", "section"]).select(
        "company_id", "section_order", "section", F.lit(-1).cast("bigint").alias("line_key"), F.col("title").alias("line"))
    first = present.groupBy(F.col("company_id").alias("_cid")).agg(F.min("section_order").alias("_first"))
    seps = (present.join(first, F.col("company_id").eqNullSafe(F.col("_cid"))).filter(F.col("section_order") > F.col("_first"))
            .select("company_id", "section_order", "section", F.lit(-2).cast("bigint").alias("line_key"),
                    F.lit("").alias("line")))
    return seps.unionByName(title_lines).unionByName(body)


def assemble_documents(lines: DataFrame) -> DataFrame:
    """Text form of :func:`context_document` (one string per tenant).  Gathers a whole
    tenant into one row: use only where document sizes are bounded."""
    return lines.groupBy("company_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_order", "line_key", "line"))),
                                 lambda x: x["line"]), "\n").alias("document"))


CHUNK = 4000      # characters of a document's chunk
FEW = 100_000     # conversations up to which their owners are sent to the chunks


def document_chunks(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """The text of each tenant's document as chunks (company_id, chunk_no, text, n_lines).

    A line belongs to the chunk in which its first character lies, so a chunk has at most ``size``
    characters and the rest of one line, and the chunks in order, joined by newlines, are the document.  A number is left out
    only where a line is longer than a chunk.  Where a line starts is a two-level sum of lengths
    (``slices``): a tenant with a third of all lines is spread over slices, and no task gathers more
    than a chunk.
    """
    x = in_slices_summed(lines.select("company_id", "section_order", "line_key", "line"), F.char_length("line") + 1, "start",
                         "company_id", "section_order", "line_key", "line", name="document-lines")
    own = F.collect_list(F.struct(SLICE, PLACE, "line"))        # of one chunk
    return (x.groupBy("company_id", F.floor(F.col("start") / size).cast("bigint").alias("chunk_no"))
            .agg(F.sort_array(own).alias("own"), F.count(F.lit(1)).alias("n_lines"))
            .select("company_id", "chunk_no", F.array_join(F.transform("own", lambda r: r["line"]), "\n").alias("text"), "n_lines"))


# ---------------------------------------------------------------------------------
# C3 / C4 — conversation history
# ---------------------------------------------------------------------------------
HISTORY_PAIRS = 6
ACKNOWLEDGEMENT = "Understood. I have access to the supply-chain data. How can I help?"


def _with_new_message(conv: DataFrame) -> DataFrame:
    """Mark each conversation's last user turn: it is the new message, earlier turns are history."""
    last_user = (conv.filter(F.col("role") == "user").groupBy("conv_id")
                 .agg(F.max("turn").alias("_new_turn")))
    return conv.join(last_user, "conv_id")


def conversation_pairs(conv: DataFrame) -> DataFrame:
    """Every history user turn paired with the immediately following turn's text when
    that turn is an assistant turn (else ''); only the last six pairs are kept.

    The last six are cut per partition before the shuffle; the turn that follows each is the first
    turn between it and the next kept one, a grouped minimum, so a conversation of any length
    is never one task."""
    x = _with_new_message(conv).filter(F.col("turn") < F.col("_new_turn")).select("conv_id", "turn", "role", "text")
    wd = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = (x.filter(F.col("role") == "user").withColumn("_r", F.row_number().over(wd)).filter(F.col("_r") <= HISTORY_PAIRS)
            .select("conv_id", F.col("turn").alias("user_turn"), F.col("text").alias("user_text"),
                    (F.lit(HISTORY_PAIRS + 1) - F.col("_r")).cast("int").alias("pair_no")))
    # at most six turns per conversation; a turn follows the latest of them before it
    turns = kept.groupBy("conv_id").agg(F.collect_list("user_turn").alias("_kept"))
    later = F.array_max(F.filter("_kept", lambda k: k < F.col("turn")))
    following = (x.join(turns, "conv_id").withColumn("user_turn", later).filter("user_turn IS NOT NULL")
                 .groupBy("conv_id", "user_turn").agg(F.min_by(F.struct("role", "text"), "turn").alias("_next")))
    return kept.join(following, ["conv_id", "user_turn"], "left").select(
        "conv_id", "user_turn", "user_text",
        F.when(F.col("_next.role") == "assistant", F.coalesce(F.col("_next.text"), F.lit(""))).otherwise(F.lit("")).alias("assistant_text"),
        "pair_no")


def prompt_turns(conv: DataFrame, context_text: Column | None = None) -> DataFrame:
    """C4: the model turns for each conversation: context preamble (user) and
    acknowledgement (model), then per kept pair its user and model turns (empty texts
    skipped), then the new message.  ``position`` orders the turns."""
    pairs = conversation_pairs(conv)
    ctx = context_text if context_text is not None else F.lit("# Live Database Context")
    convs = _with_new_message(conv)
    newmsg = convs.filter(F.col("turn") == F.col("_new_turn")).select("conv_id", F.col("text").alias("_msg"))
    pre = newmsg.select("conv_id", F.array(
        F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), ctx.alias("text")),
        F.struct(F.lit(1).alias("k"), F.lit("model").alias("role"), F.lit(ACKNOWLEDGEMENT).alias("text")))
        .alias("turns"))
    hist = pairs.select("conv_id", F.array(
        F.struct((F.col("user_turn") * 2 + 2).alias("k"), F.lit("user").alias("role"),
                 F.col("user_text").alias("text")),
        F.struct((F.col("user_turn") * 2 + 3).alias("k"), F.lit("model").alias("role"),
                 F.col("assistant_text").alias("text"))).alias("turns"))
    last = newmsg.select("conv_id", F.array(F.struct(F.lit(1 << 40).cast("bigint").alias("k"),
                                                     F.lit("user").alias("role"),
                                                     F.col("_msg").alias("text"))).alias("turns"))
    allt = reduce(lambda a, b: a.unionByName(b), [
        pre.select("conv_id", F.explode("turns").alias("x")),
        hist.select("conv_id", F.explode("turns").alias("x")),
        last.select("conv_id", F.explode("turns").alias("x"))])
    allt = allt.select("conv_id", F.col("x.k").cast("bigint").alias("k"), F.col("x.role").alias("role"),
                       F.col("x.text").alias("text"))
    allt = allt.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    w = Window.partitionBy("conv_id").orderBy("k")
    return allt.select("conv_id", F.row_number().over(w).cast("int").alias("position"), "role", "text")


def prompt_contents(t, owners: DataFrame, size: int = CHUNK) -> DataFrame:
    """C4 with its context: (conv_id, position, part, role, text), all that the model gets for each conversation.

    The first turn of a conversation is the preamble of the company in ``owners`` (conv_id, company_id), in chunks:
    its parts joined by newlines are the turn.  A conversation without a company of the tables has
    the heading alone.  All other turns are of one part.

    A chunk is met by the conversations of its company one after the other: rows with the same text lie
    side by side, where a columnar file holds them hardly larger than one.  The chunks are written, so that the
    shuffles that made them are gone when the far larger result is.
    """
    parts = written(t.spark, document_chunks(prompt_preamble(t), size).select(
        "company_id", F.col("chunk_no").alias("part"), F.col("text").alias("_text")), "prompt-chunks")
    turns = prompt_turns(t.conversations)
    first = written(t.spark, turns.filter("position = 1").join(owners.select("conv_id", "company_id"), "conv_id", "left"), "prompt-first")
    known = parts.select("company_id").distinct()        # each line is in a chunk
    alone = first.join(known, "company_id", "left_anti").select("conv_id", "position", F.lit(0).cast("bigint").alias("part"), "role", "text")
    # the chunks are never the side that is looked up
    first = first.hint("broadcast" if first.count() <= FEW else "merge")
    first = parts.join(first, "company_id").select("conv_id", "position", "part", "role", F.col("_text").alias("text")).unionByName(alone)
    rest = turns.filter("position > 1").select("conv_id", "position", F.lit(0).cast("bigint").alias("part"), "role", "text")
    return first.unionByName(rest)

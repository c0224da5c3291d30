"""The catalogue of tasks, executions, objects and sources.

Lookup, listing, paging, projection, masking of columns, retention, and writes
expressed as new DataFrames (plain Parquet has no MERGE; write the result to a
new path, never over the one being read).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.values import iso_time, key_fraction, moment, url_host
from gleanery.operators.validation import MAX_OBJECT_BYTES, TRANSITIONS, Rule, validate
from gleanery.plans import slices

# Days each class of object is kept.
RETENTION_DAYS = {"raw": 90, "documents": 365, "ocr": 180, "logs": 30}

# Credential keys that are stored encrypted.
SENSITIVE_KEYS = ("api_key", "password", "secret", "token", "service_account")

MAX_PAGE_SIZE = 1000


# --- filters and lookups ---------------------------------------------------


def filter_eq(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """AND of ``field = value``; reaches the Parquet scan."""
    return reduce(lambda d, item: d.filter(F.col(item[0]) == F.lit(item[1])), filters.items(), df)


def get_by_id(df: DataFrame, value, id_col: str = "id") -> DataFrame:
    """The row with this id, or no row."""
    return df.filter(F.col(id_col) == F.lit(value)).limit(1)


def get_by_name(df: DataFrame, name: str) -> DataFrame:
    return get_by_id(df, name, "name")


def owned_by(df: DataFrame, owner, owner_col: str = "owner") -> DataFrame:
    return df.filter(F.col(owner_col) == F.lit(owner))


def active_of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.filter((F.col("type") == kind) & F.col("is_active"))


def allowed_domains(df: DataFrame, url: str, domains: Sequence[str]) -> DataFrame:
    """Keep urls whose host is one of ``domains`` or below one."""
    wanted = sorted({d.strip().lower() for d in domains if d and d.strip()})
    if not wanted:
        return df.filter(F.lit(False))
    labels = F.split(url_host(F.col(url)), "[.]")
    # a.b.c -> [a.b.c, b.c, c]
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return df.filter(F.arrays_overlap(suffixes, F.array(*[F.lit(d) for d in wanted])))


def sample_by_key(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """All rows of a stable share of the keys, the same keys on every run."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    return df.filter(key_fraction(F.col(key)) < F.lit(float(fraction)))


def size_limit(df: DataFrame, size: str, limit: int = MAX_OBJECT_BYTES) -> DataFrame:
    return df.filter(F.col(size) <= limit)


def filter_logs(
    df: DataFrame, level: str | None = None, since: datetime | None = None, contains: str | None = None, now: datetime | None = None, keep_days: int = 90
) -> DataFrame:
    """Log search; entries older than ``keep_days`` before ``now`` never show."""
    if level is not None:
        df = df.filter(F.col("level") == level)
    if since is not None:
        df = df.filter(F.col("ts") >= moment(since))
    if now is not None:
        df = df.filter(F.col("ts") >= moment(now) - F.expr(f"INTERVAL {int(keep_days)} DAYS"))
    if contains is not None:
        df = df.filter(F.col("message").contains(contains))
    return df


# --- projections -----------------------------------------------------------


def search_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"type_status": F.concat_ws("_", "type", "status"), "created_date": F.date_format("created_at", "yyyy-MM-dd")}
    )


def task_response(df: DataFrame, base_url: str = "/api/v1/tasks") -> DataFrame:
    """``(id, body)``: the task as JSON with text ids, ISO times and links; nulls left out."""
    task_id = F.col("id").cast("string")
    self_link = F.concat(F.lit(f"{base_url}/"), task_id)
    links = F.create_map(F.lit("self"), self_link, F.lit("status"), F.concat(self_link, F.lit("/status")))
    fields = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name == "id":
            column = task_id
        elif field.dataType.typeName().startswith("timestamp"):
            column = iso_time(column)
        fields.append(column.alias(field.name))
    return df.select("id", F.to_json(F.struct(*fields, links.alias("links"))).alias("body"))


def storage_paths(df: DataFrame, bucket: str, execution: str, object_id: str, created: str) -> DataFrame:
    """The execution path plus the documented layout path of each class."""
    date = F.date_format(created, "yyyy-MM-dd")
    oid = F.col(object_id).cast("string")
    return df.withColumns(
        {
            "execution_path": F.concat(F.lit(f"gs://{bucket}/executions/"), F.col(execution).cast("string"), F.lit("/"), oid),
            "document_path": F.concat(F.lit("/documents/"), F.date_format(created, "yyyy/MM"), F.lit("/"), oid),
            "ocr_path": F.concat(F.lit("/ocr_results/"), oid, F.lit("/"), F.date_format(created, "yyyyMMddHHmmss")),
            "dated_path": F.concat(F.date_format(created, "yyyy/MM/dd"), F.lit("/"), oid),
            "log_date_path": F.concat(F.lit("/logs/"), date),
        }
    )


def enrich_metadata(df: DataFrame, metadata: str, **values: Column) -> DataFrame:
    """Merge ``values`` over a string map; later keys win (needs the LAST_WIN map policy)."""
    pairs = [c for name, value in values.items() for c in (F.lit(name), value.cast("string"))]
    given = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
    return df.withColumn(metadata, F.map_concat(given, F.create_map(*pairs)))


def mask_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Replace whole text columns by ``***MASKED_<field>***``; others stay."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.withColumns(
        {f: F.when(F.col(f).isNotNull(), F.lit(f"***MASKED_{f}***")) for f in fields if kinds.get(f) == "string"}
    )


def encrypt_cols(df: DataFrame, columns: Sequence[str], key: Column) -> DataFrame:
    """AES-256-GCM per value: 12-byte IV, ciphertext, 16-byte tag. ``key`` is 32 bytes."""
    return df.withColumns({c: F.aes_encrypt(F.col(c).cast("binary"), key, F.lit("GCM")) for c in columns})


def decrypt_cols(df: DataFrame, columns: Sequence[str], key: Column) -> DataFrame:
    """Back to text; null where the key or the bytes are wrong."""
    return df.withColumns({c: F.try_aes_decrypt(F.col(c), key, F.lit("GCM")).cast("string") for c in columns})


def encrypt_sensitive(df: DataFrame, credentials: str, key: Column) -> DataFrame:
    """Encrypt (as base64 text) the values under the sensitive keys of a credentials map."""

    def seal(name: Column, value: Column) -> Column:
        sealed = F.base64(F.aes_encrypt(value.cast("binary"), key, F.lit("GCM")))
        return F.when(name.isin(*SENSITIVE_KEYS), sealed).otherwise(value)

    return df.withColumn(credentials, F.transform_values(credentials, seal))


def decrypt_sensitive(df: DataFrame, credentials: str, key: Column) -> DataFrame:
    def unseal(name: Column, value: Column) -> Column:
        plain = F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")
        return F.when(name.isin(*SENSITIVE_KEYS), plain).otherwise(value)

    return df.withColumn(credentials, F.transform_values(credentials, unseal))


# --- joins -----------------------------------------------------------------


def attach_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with each of their children, parents without any kept with nulls.

    ``key`` is unique among the parents and may be very unevenly spread among
    the children. An outer join could not split a parent's many children over
    tasks; an inner join can, and the childless parents are added apart.
    """
    matched = children.join(parents, key)
    childless = parents.join(children.select(key).distinct(), key, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def lineage(sources: DataFrame, tasks: DataFrame, executions: DataFrame, objects: DataFrame) -> DataFrame:
    """source -> task -> execution -> object, keeping parents without children.

    Children carry ``source_id`` / ``task_id`` / ``execution_id``; ids are unique.
    """
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    t = tasks.select(F.col("id").alias("task_id"), "source_id", F.col("status").alias("task_status"))
    e = executions.select(F.col("id").alias("execution_id"), "task_id", F.col("status").alias("execution_status"))
    o = objects.select(F.col("id").alias("object_id"), "execution_id", "storage_path")
    return attach_children(attach_children(attach_children(s, t, "source_id"), e, "task_id"), o, "execution_id")


def with_task_metrics(tasks: DataFrame, metrics: DataFrame, key: str = "id") -> DataFrame:
    """Metrics per listed task, null when there are none."""
    return tasks.join(metrics, key, "left")


def overlay_metadata(objects: DataFrame, cached: DataFrame, key: str = "id", metadata: str = "metadata", order: str | None = None) -> DataFrame:
    """Cached metadata keys override stored ones.

    Of several cached entries for a key the last by ``order`` counts; without an order,
    and among equals, the last by their JSON text.
    """
    text = F.to_json(metadata)
    latest = F.max_by(F.col(metadata), F.struct(F.col(order), text) if order else F.coalesce(text, F.lit("")))
    over = cached.groupBy(key).agg(latest.alias("__cached"))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.coalesce(metadata, empty), F.coalesce("__cached", empty))
    return objects.join(over, key, "left").withColumn(metadata, merged).drop("__cached")


def list_by_execution(objects: DataFrame, execution_id, filters: Mapping[str, object] | None = None) -> DataFrame:
    return filter_eq(objects, {"execution_id": execution_id, **(filters or {})})


def upsert(current: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Updates replace rows with the same key and add the rest. ``updates`` is unique per key."""
    kept = current.join(updates.select(key), key, "left_anti")
    return kept.unionByName(updates)


def update_existing(current: DataFrame, updates: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(new state, updates whose key does not exist)."""
    known = updates.join(current.select(key), key, "left_semi")
    return upsert(current, known, key), updates.join(current.select(key), key, "left_anti")


def create_new(current: DataFrame, rows: DataFrame, key: str = "id", order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, rows refused because their key exists).

    Of several new rows with one key the first in ``order`` (all columns by default)
    is created and the others are refused, as they find it there.
    """
    order = list(order or [c for c in rows.columns if c != key])
    placed = slices.number_rows(slices.by_range(rows, [key], order), [key], order, "__place")
    known = current.select(F.col(key).alias("__known")).distinct()
    judged = placed.join(known, F.col(key) == F.col("__known"), "left")
    new = F.col("__known").isNull() & (F.col("__place") == 1)
    created = judged.filter(new).select(*rows.columns)
    return current.unionByName(created), judged.filter(~new).select(*rows.columns)


def delete_rows(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not listed; deleting twice changes nothing."""
    return current.join(ids.select(key), key, "left_anti")


def apply_writes(current: DataFrame, ops: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Apply a batch ``(op, seq, <current columns>)`` of create / update / delete.

    Per key the operations run in ``seq`` order; the last legal one decides.
    Returns (new state, rejected operations with a reason): creating what
    exists, updating or deleting what does not. A create after a delete in the
    same batch is legal, so existence is followed operation by operation. A key
    with very many operations is worked on in slices of bounded size.
    """
    columns = current.columns
    others = [c for c in columns if c != key]
    parts = slices.parts_for(ops.sparkSession, ops.count() + current.count())
    dealt = (lambda x: x.repartition(parts, key)) if parts else (lambda x: x)
    # A key that exists comes before its operations, as if it had just been created; so the
    # operations are not joined. It brings the number of its rows, for each of which a
    # rejected operation is reported.
    given = current.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__copies")).withColumn("__given", F.lit(0))
    rows = ops.withColumn("__given", F.lit(1)).unionByName(given, allowMissingColumns=True)
    # Create leaves the key present and delete leaves it absent, legal or not;
    # so the last of them before an operation says whether the key exists.
    present = F.when((F.col("__given") == 0) | (F.col("op") == "create"), F.lit(True)).when(F.col("op") == "delete", F.lit(False))
    order = ["__given", "seq"]
    values = {"__exists": slices.Running("before", present), "__copies": slices.Running("max", F.col("__copies"))}
    ordered = slices.running(slices.by_range(rows, [key], order, parts), [key], order, values, parts=parts)
    judged = (
        ordered.filter(F.col("__given") == 1)
        .withColumn("__exists", F.coalesce("__exists", F.lit(False)))
        .withColumn(
            "reason",
            F.when((F.col("op") == "create") & F.col("__exists"), F.lit("already exists"))
            .when(F.col("op").isin("update", "delete") & ~F.col("__exists"), F.lit("not found"))
            .when(~F.col("op").isin("create", "update", "delete"), F.lit("unknown operation")),
        )
    )
    legal = judged.filter(F.col("reason").isNull())
    final = legal.groupBy(key).agg(F.max_by(F.struct("op", *others), "seq").alias("w"))
    # Old and new rows of a key meet once, so the operations are judged once. A null key
    # equals no other: its old rows stay, whatever is written under it.
    both = current.withColumn("__w", F.lit(False)).unionByName(
        final.select(key, *[F.col(f"w.{c}").alias(c) for c in others], F.col("w.op").alias("__op"), F.lit(True).alias("__w")), allowMissingColumns=True
    )
    settled = dealt(both).withColumn("__settled", F.max("__w").over(Window.partitionBy(key)))
    kept = F.when(F.col("__w"), F.col("__op") != "delete").otherwise(F.col(key).isNull() | ~F.col("__settled"))
    state = settled.filter(kept).select(*columns)
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce("__copies", F.lit(1)).cast("int")))
    rejected = judged.filter(F.col("reason").isNotNull()).select(*ops.columns, "reason", copies.alias("__copy")).drop("__copy")
    return state, rejected


def unique_violations(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of ``new`` that exist already or occur more than once in it."""
    counts = new.groupBy(key).agg(F.count("*").alias("copies"))
    taken = current.select(key).distinct().withColumn("taken", F.lit(True))
    return (
        counts.join(taken, key, "left")
        .withColumn("taken", F.coalesce("taken", F.lit(False)))
        .filter(F.col("taken") | (F.col("copies") > 1))
    )


def expire(objects: DataFrame, now: datetime, kind: str = "class", created: str = "created_at", days: Mapping[str, int] = RETENTION_DAYS, default_days: int = 90) -> DataFrame:
    """Add ``expired``: older than the age its class is kept for."""
    age = F.lit(default_days)
    for name, limit in days.items():
        age = F.when(F.col(kind) == name, F.lit(limit)).otherwise(age)
    cutoff = moment(now) - F.make_dt_interval(age)
    return objects.withColumn("expired", F.col(created).cast("timestamp") < cutoff)


def orphans(child: DataFrame, parent: DataFrame, foreign_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent does not exist."""
    keys = parent.select(F.col(parent_key).alias(foreign_key))
    return child.join(keys, foreign_key, "left_anti")


def may_move(current: Column, wanted: Column) -> Column:
    """Whether a status may change from ``current`` to ``wanted``."""
    legal = F.lit(False)
    for start, ends in TRANSITIONS.items():
        for end in ends:
            legal = legal | ((current == start) & (wanted == end))
    return F.coalesce(legal, F.lit(False))


def allowed_moves(current: Column) -> Column:
    """Comma-separated statuses reachable from ``current``."""
    out = F.lit(None).cast("string")
    for start, ends in TRANSITIONS.items():
        out = F.when(current == start, F.lit(",".join(ends))).otherwise(out)
    return out


def apply_status(tasks: DataFrame, updates: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Set status where the move is legal; report the other requests.

    ``updates`` is ``(id, wanted, seq)``; of several for one task the first by ``seq``
    counts, and at the same ``seq`` the alphabetically first. Returns (tasks, rejected with
    current, wanted and allowed statuses; ``current`` is null for unknown ids).
    """
    first = F.min(F.struct("seq", "wanted"))
    wanted = updates.filter(F.col("wanted").isNotNull()).groupBy("id").agg(first["wanted"].alias("wanted"))
    moved = tasks.join(wanted, "id", "left")
    ok = may_move(F.col("status"), F.col("wanted"))
    state = moved.withColumns(
        {
            "updated_at": F.when(ok, moment(now)).otherwise(F.col("updated_at")),
            "status": F.when(ok, F.col("wanted")).otherwise(F.col("status")),
        }
    ).drop("wanted")
    current = tasks.select("id", F.col("status").alias("current"))
    rejected = (
        wanted.join(current, "id", "left")
        .filter(~may_move(F.col("current"), F.col("wanted")))
        .withColumn("allowed", allowed_moves(F.col("current")))
    )
    return state, rejected


def merge_config(sources: DataFrame, updates: DataFrame, rules: Sequence[Rule], now: datetime) -> DataFrame:
    """Merge ``updates(id, changes map)`` over ``configuration``.

    ``rules`` are evaluated on the merged row. A row they reject keeps its old
    configuration and time and reports the broken rules in ``errors``.
    """
    joined = sources.join(updates.select("id", "changes"), "id", "left")
    merged = F.when(F.col("changes").isNotNull(), F.map_concat("configuration", "changes")).otherwise(F.col("configuration"))
    trial = validate(joined.withColumns({"__old": F.col("configuration"), "configuration": merged}), rules)
    accepted = F.col("changes").isNotNull() & (F.size("errors") == 0)
    return trial.withColumns(
        {
            "configuration": F.when(accepted, F.col("configuration")).otherwise(F.col("__old")),
            "updated_at": F.when(accepted, moment(now)).otherwise(F.col("updated_at")),
            "errors": F.when(F.col("changes").isNotNull(), F.col("errors")),
        }
    ).drop("__old", "changes")


# --- paging ----------------------------------------------------------------


def _check_size(size: int) -> int:
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page size must lie in 1..{MAX_PAGE_SIZE}")
    return size


def list_by_status(tasks: DataFrame, status: str, limit: int = 100, cursor: tuple | None = None) -> DataFrame:
    """Newest first, ids breaking ties, after ``cursor = (created_at, id)``."""
    return _newest(tasks.filter(F.col("status") == status), limit, cursor)


def list_by_type(tasks: DataFrame, kind: str, limit: int = 100, cursor: tuple | None = None) -> DataFrame:
    return _newest(tasks.filter(F.col("type") == kind), limit, cursor)


def _newest(tasks: DataFrame, limit: int, cursor: tuple | None) -> DataFrame:
    if cursor is not None:
        created, task_id = cursor
        older = F.col("created_at") < moment(created)
        tasks = tasks.filter(older | ((F.col("created_at") == moment(created)) & (F.col("id") > F.lit(task_id))))
    return tasks.orderBy(F.col("created_at").desc(), "id").limit(_check_size(limit))


def page_offset(df: DataFrame, order: Sequence[Column | str], page: int, size: int = 100) -> DataFrame:
    """One row: ``items`` of the page in order, ``total_items, total_pages, has_next, has_prev``.

    A page past the end has no items and the same totals. Rows are numbered over a range
    partitioning, so no offset passes through one task; a page is ``size`` rows at most.
    """
    if page < 1:
        raise ValueError("pages start at 1")
    _check_size(size)
    numbered = slices.number_all(df, order, "__no")
    rows = numbered.filter(F.col("__no").between((page - 1) * size + 1, page * size))
    items = F.array_sort(F.collect_list(F.struct("__no", F.struct(*df.columns).alias("item"))))
    envelope = rows.agg(F.transform(items, lambda x: x["item"]).alias("items"))
    total = df.select(F.lit(1)).agg(F.count("*").alias("n")).scalar()
    return envelope.withColumn("total_items", total).withColumn("total_pages", F.ceil(F.col("total_items") / F.lit(size))).withColumns(
        {"has_next": F.lit(page) < F.col("total_pages"), "has_prev": F.lit(page > 1)}
    )


def page_keyset(df: DataFrame, key: str, id_col: str, after: tuple | None, size: int = 100) -> DataFrame:
    """The page after ``after = (key, id)``, with ``next_key, next_id``: null unless the page is full."""
    _check_size(size)
    if after is not None:
        past = F.col(key) > moment(after[0])
        df = df.filter(past | ((F.col(key) == moment(after[0])) & (F.col(id_col) > F.lit(after[1]))))
    # At most MAX_PAGE_SIZE rows reach the un-keyed window.
    page = df.orderBy(key, id_col).limit(size)
    whole = Window.orderBy(key, id_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.count("*").over(whole) == size
    return page.withColumns(
        {
            "next_key": F.when(full, F.last(key).over(whole)),
            "next_id": F.when(full, F.last(id_col).over(whole)),
        }
    )


def due_tasks(tasks: DataFrame, now: datetime, kind: str | None = None) -> DataFrame:
    """Pending tasks that may run now, oldest first."""
    ready = F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= moment(now))
    due = tasks.filter((F.col("status") == "pending") & ready)
    if kind is not None:
        due = due.filter(F.col("type") == kind)
    return due.orderBy("created_at", "id")

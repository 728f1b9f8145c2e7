"""Filters, projections and joins over the experiment registry."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.functions.text import data_category, data_format
from trialmesh.scale import top_rows

# Run states that still change, and states that do not.
ACTIVE_STATUSES = ("created", "awaiting_clarification", "profiling", "planning", "awaiting_confirmation",
                   "queued", "running")
TERMINAL_STATUSES = ("completed", "failed")


def list_by_scope(df: DataFrame, scope_col: str, value, order_col: str) -> DataFrame:
    """Rows of one tenant, newest first."""
    return df.where(F.col(scope_col) == F.lit(value)).orderBy(F.col(order_col).desc())


def registry_projection(df: DataFrame) -> DataFrame:
    """Client view of datasets: text ids, first known path, inferred format and category."""
    path = F.coalesce("s3_path", "storage_uri")
    columns = set(df.columns)
    known = (lambda c: F.col(c)) if {"data_format", "data_category"} <= columns else (lambda c: F.lit(None).cast("string"))
    fmt = F.coalesce(known("data_format"), data_format(path))
    best = F.col("is_best") if "is_best" in columns else F.lit(None).cast("boolean")
    return df.select(
        F.col("id").cast("string").alias("id"), F.col("use_case_id").cast("string").alias("use_case_id"),
        path.alias("path"), fmt.alias("data_format"),
        F.coalesce(known("data_category"), data_category(fmt)).alias("data_category"),
        F.coalesce(best, F.lit(False)).alias("is_best"),
        F.col("total_price").cast("double").alias("total_price"), F.col("created_at"))


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality filter for each keyword whose value is not None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def flag_in_set(df: DataFrame, column: str, values: Sequence[str], out: str) -> DataFrame:
    """True when the lower-cased column is one of ``values``; null counts as no."""
    hit = F.lower(F.col(column)).isin([v.lower() for v in values])
    return df.withColumn(out, F.coalesce(hit, F.lit(False)))


def transition_status(df: DataFrame, from_set: Sequence[str], to: str, terminal_set: Sequence[str], reason: str,
                      status: str = "status") -> DataFrame:
    """Move rows in ``from_set`` to ``to``, keeping the previous status; report terminal rows as refused."""
    moves = F.coalesce(F.col(status).isin(list(from_set)), F.lit(False))
    return df.select(
        *[c for c in df.columns if c != status],
        F.when(moves, F.lit(to)).otherwise(F.col(status)).alias(status),
        F.when(moves, F.col(status)).alias("previous_status"),
        F.when(moves, F.lit(reason)).alias("error"),
        F.coalesce(F.col(status).isin(list(terminal_set)), F.lit(False)).alias("refused"))


def memberships(orgs: DataFrame, members: DataFrame, user=None) -> DataFrame:
    """Organisations a user belongs to, newest membership first."""
    mine = optional_filters(members, user_id=user)
    named = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    return mine.join(named, "organization_id").orderBy(F.col("membership_id").desc())


def use_cases_with_project(use_cases: DataFrame, projects: DataFrame, org=None, project=None) -> DataFrame:
    """Use cases with their project, within an organisation and optionally one project."""
    scope = optional_filters(projects, organization_id=org, id=project).select(
        F.col("id").alias("project_id"), "organization_id", F.col("name").alias("project_name"))
    return use_cases.join(scope, "project_id")


def accessible(df: DataFrame, members: DataFrame, user, scope: str = "organization_id") -> DataFrame:
    """Rows whose scope the user is a member of."""
    mine = members.where(F.col("user_id") == F.lit(user)).select(F.col("organization_id").alias(scope))
    return df.join(mine, scope, "left_semi")


def denied(df: DataFrame, members: DataFrame, user, scope: str = "organization_id") -> DataFrame:
    """The complement of :func:`accessible`."""
    mine = members.where(F.col("user_id") == F.lit(user)).select(F.col("organization_id").alias(scope))
    return df.join(mine, scope, "left_anti")


def datasets_with_project(datasets: DataFrame, use_cases: DataFrame, projects: DataFrame) -> DataFrame:
    """Datasets with the project named by the dataset itself, else by its use case."""
    owner = use_cases.select(F.col("id").alias("use_case_id"), F.col("project_id").alias("via_use_case"),
                             F.col("name").alias("use_case_name"))
    scope = projects.select(F.col("id").alias("project_id"), "organization_id", F.col("name").alias("project_name"))
    found = datasets.join(owner, "use_case_id", "left")
    found = found.withColumn("project_id", F.coalesce("project_id", "via_use_case")).drop("via_use_case")
    return found.join(scope, "project_id")


def model_registry(runs: DataFrame, datasets: DataFrame, use_cases: DataFrame, projects: DataFrame,
                   entries: DataFrame, org=None, project=None) -> DataFrame:
    """Training runs with dataset, use case, project and leaderboard entries; newest first, then rank."""
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("project_id").alias("d_project"),
                        F.coalesce("s3_path", "storage_uri").alias("dataset_path"))
    u = use_cases.select(F.col("id").alias("use_case_id"), F.col("project_id").alias("u_project"),
                         F.col("name").alias("use_case_name"))
    p = optional_filters(projects, organization_id=org, id=project).select(
        F.col("id").alias("the_project"), "organization_id", F.col("name").alias("project_name"))
    e = entries.withColumnRenamed("training_run_id", "training_run")
    r = runs.select(F.col("id").alias("training_run"), "dataset_id", "use_case_id", "project_id", "created_at")
    rows = r.join(d, "dataset_id").join(u, "use_case_id")
    rows = rows.withColumn("the_project", F.coalesce("project_id", "d_project", "u_project")).join(p, "the_project")
    rows = rows.join(e, "training_run", "left")
    order = [F.col("created_at").desc(), F.col("rank").asc_nulls_last(), "training_run", *[
        c for c in ("part", "supp", "shipped") if c in e.columns]]
    return rows.select(
        F.col("training_run").alias("training_run_id"), "organization_id", F.col("the_project").alias("project_id"),
        "project_name", "use_case_id", "use_case_name", "dataset_id", "dataset_path", "created_at", "rank",
        "metric_value", *[c for c in ("part", "supp", "shipped") if c in e.columns]).orderBy(*order)


def valid_at(sessions: DataFrame, users: DataFrame, at: datetime | Column) -> DataFrame:
    """Sessions of active users that are neither revoked nor expired at ``at``."""
    moment = at if isinstance(at, Column) else F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    live = sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > moment))
    return live.join(users.where("active").select("user_id"), "user_id")


def attach_sources(problems: DataFrame, sources: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Last source per problem (``order`` is newest first); the url is kept only when the path is empty."""
    last = top_rows(sources.where(F.col(key).isNotNull()), [key], order)
    path = F.coalesce("s3_path", F.lit(""))
    return problems.join(last.select(key, "s3_path", "dataset_url", "row_count"), key, "left").select(
        *[F.col(c) for c in problems.columns], path.alias("s3_path"), F.col("row_count"),
        F.when((path == "") & (F.col("dataset_url") != ""), F.col("dataset_url")).alias("dataset_url"))


def fill_from_lookup(df: DataFrame, lookup: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Fill missing values of ``cols`` from ``lookup``; rows without a match stay as they are.

    No broadcast hint: the planner broadcasts the lookup only when its size allows.
    """
    side = lookup.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    filled = df.join(side, key, "left")
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def apply_overrides(inferred: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confirmed name = override, else inferred name, else empty."""
    return inferred.join(overrides.select(*keys, "override"), list(keys), "left").select(
        *inferred.columns, F.coalesce("override", "inferred_name", F.lit("")).alias("confirmed_name"),
        F.lit(True).alias("user_confirmed"))


def resolve_columns(requests: DataFrame, columns: DataFrame, policy: str = "exact") -> DataFrame:
    """Match requested column names against each dataset's header.

    ``requests``: dataset, requested.  ``columns``: dataset, header (array of names in order).
    ``exact``: as written, then case-folded, then letters and digits only (the last
    duplicate wins), else unresolved.  ``suggest``: equal ignoring case, then either
    name containing the other, then the first column; ``mismatch`` marks names that
    are in the header under no case.
    """
    want = F.col("requested")
    rows = requests.join(columns, "dataset", "left")
    header = F.coalesce("header", F.array().cast("array<string>"))

    def hits(test):
        return F.filter(header, test)

    folded = hits(lambda c: F.lower(c) == F.lower(want))
    if policy == "exact":
        squeeze = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
        same = hits(lambda c: c == want)
        loose = hits(lambda c: squeeze(c) == squeeze(want))
        resolved = F.coalesce(*[F.try_element_at(a, F.lit(-1)) for a in (same, folded, loose)])
        tier = (F.when(F.size(same) > 0, "exact").when(F.size(folded) > 0, "casefold")
                .when(F.size(loose) > 0, "alphanumeric").otherwise("unresolved"))
        return rows.select(*requests.columns, resolved.alias("resolved"), tier.alias("tier"))
    if policy != "suggest":
        raise ValueError(f"unknown policy {policy!r}")
    inside = hits(lambda c: F.lower(c).contains(F.lower(want)) | F.lower(want).contains(F.lower(c)))
    resolved = F.coalesce(F.try_element_at(folded, F.lit(1)), F.try_element_at(inside, F.lit(1)),
                          F.try_element_at(header, F.lit(1)), want)
    return rows.select(*requests.columns, resolved.alias("resolved"),
                       ((F.size(header) > 0) & (F.size(folded) == 0)).alias("mismatch"))


def attach_gt_contents(qa: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ground-truth ids of each question replaced by their contents, order kept.

    ``qa``: qid, retrieval_gt (array of ids).  ``corpus``: doc_id, contents.  One row per
    (qid, position), so a question that cites most of the corpus is not one huge cell;
    ids missing from the corpus give null contents.
    """
    wanted = qa.select("qid", F.posexplode("retrieval_gt").alias("position", "doc_id"))
    return wanted.join(corpus.select("doc_id", "contents"), "doc_id", "left")


def enrich_with_provenance(seed: DataFrame, enrichment: DataFrame, sources: str, keys: Sequence[str],
                           confidence: float = 0.8) -> DataFrame:
    """Add the enrichment's columns to the seed; one row per record and field with where it came from.

    ``sources`` names the enrichment column holding the source url.
    """
    added = [c for c in enrichment.columns if c not in (*keys, sources)]
    wide = seed.join(enrichment, list(keys), "left")
    seed_fields = [c for c in seed.columns if c not in keys]

    def field(name: str, origin: str, url: Column, sure: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"), F.lit(origin).alias("origin"),
                        url.alias("source_url"), sure.alias("confidence"))

    nothing = F.lit(None).cast("string")
    cells = [field(c, "uploaded", nothing, F.lit(1.0)) for c in seed_fields]
    cells += [field(c, "enriched", F.col(sources), F.when(F.col(c).isNotNull(), F.lit(confidence)).otherwise(F.lit(0.0)))
              for c in added]
    return wide.select(*keys, F.inline(F.array(*cells)))


def cascade_delete(tables: Sequence[tuple[str, DataFrame, str, str | None]], root_keys: DataFrame) -> dict[str, DataFrame]:
    """Delete root rows and all that reference them, table by table.

    ``tables`` lists (name, frame, primary key, foreign key to the table before); the
    first entry is the root.  Returns the remaining rows per table.
    """
    left: dict[str, DataFrame] = {}
    gone = root_keys
    for name, df, primary, foreign in tables:
        link = foreign or primary
        doomed = gone.select(F.col(gone.columns[0]).alias(link))
        left[name] = df.join(doomed, link, "left_anti")
        gone = df.join(doomed, link, "left_semi").select(primary)
    return left

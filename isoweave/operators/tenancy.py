"""Row visibility by membership: a row is seen by the members of the organisation that owns it through its project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def organisations(members: DataFrame, user: str) -> DataFrame:
    """Distinct organisations of a user."""
    return members.filter((F.col("user_id") == user) & F.col("organization_id").isNotNull()).select("organization_id").distinct()


def projects_of(projects: DataFrame, members: DataFrame, user: str) -> DataFrame:
    return projects.join(organisations(members, user), "organization_id", "left_semi")


def visible(rows: DataFrame, projects: DataFrame, members: DataFrame, user: str, documents: DataFrame | None = None) -> DataFrame:
    """Rows of a table that hangs on projects, or on documents of projects; rows of no project are seen by nobody."""
    mine = projects_of(projects, members, user).select(F.col("id").alias("_p"))
    if documents is None:
        return rows.join(mine, F.col("project_id") == F.col("_p"), "left_semi")
    docs = documents.join(mine, F.col("project_id") == F.col("_p"), "left_semi").select(F.col("id").alias("_d"))
    return rows.join(docs, F.col("document_id") == F.col("_d"), "left_semi")


def global_or_mine(rows: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """Rows of no organisation and those of the user's."""
    mine = organisations(members, user).withColumnRenamed("organization_id", "_o").withColumn("_in", F.lit(True))
    return rows.join(mine, F.col("organization_id") == F.col("_o"), "left").filter(F.col("organization_id").isNull() | F.col("_in")).drop("_o", "_in")


def require_member(projects: DataFrame, members: DataFrame, project: str, user: str) -> None:
    """Raises PermissionError unless the user belongs to the project's organisation."""
    if projects_of(projects.filter(F.col("id") == project), members, user).isEmpty():
        raise PermissionError(f"{user} is no member of the organisation of {project}")


def by_organisation(projects: DataFrame, members: DataFrame, organisations_: DataFrame, user: str) -> DataFrame:
    """(organization_id, name, projects): the user's organisations with their projects' ids in order; those without any have none."""
    mine = organisations_.join(organisations(members, user), organisations_["id"] == F.col("organization_id"), "left_semi")
    held = projects.groupBy("organization_id").agg(F.array_sort(F.collect_list("id")).alias("projects"))
    return mine.join(held, mine["id"] == held["organization_id"], "left").select(mine["id"].alias("organization_id"), "name", F.coalesce("projects", F.array().cast("array<string>")).alias("projects"))

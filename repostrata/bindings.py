"""Canonical tables derived from the driver tables, whole tables at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.latest import PR
from .sources.tables import table_scan

AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-03-31"


class Tables:
    """Lazy access to the canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table_scan(self.spark, self.folder, name)

    # --- dimension tables ------------------------------------------------------

    def projects(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.raw("region").select(
            key.cast("long").alias("id"),
            F.col("r_name").alias("name"),
            F.when(key % 2 == 0, F.concat(F.lit("Portfolio of "), "r_name")).alias("description"),
        )

    def project_repositories(self) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        return self.raw("nation").select(
            key.alias("id"),
            F.col("n_regionkey").cast("long").alias("project_id"),
            (key % 20).alias("repository_id"),
            F.col("n_name").alias("name"),
            F.lit("main").alias("default_branch"),
        )

    def repositories(self) -> DataFrame:
        """Links beyond the 20th share a repository; 30 and 31 are linked by nobody."""
        key = F.col("n_nationkey").cast("long")
        id_ = F.when(key >= 23, key + 7).otherwise(key % 20)
        provider = F.when(F.col("id") % 3 == 0, "github").when(F.col("id") % 3 == 1, "gitlab").otherwise("bitbucket")
        url = F.when(
            F.col("id") % 2 == 0,
            F.concat(F.lit("https://user@git.example.org/team/repo_"), F.col("id"), F.lit(".git")),
        ).otherwise(F.concat(F.lit("git@github.com:team/repo_"), F.col("id"), F.lit(".git")))
        return (
            self.raw("nation").select(id_.alias("id")).distinct()
            .select("id", url.alias("url"), provider.alias("provider"))
        )

    def profiles(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("id"),
            F.floor(key / 3).cast("long").alias("developer_id"),
            F.col("c_name").alias("canonical_username"),
            F.when(key % 7 != 0, F.concat("c_mktsegment", F.lit(" "), key.cast("string"))).alias("display_name"),
            F.concat(F.lit("user"), key.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com")).alias("primary_email"),
        )

    def developer_tags(self) -> DataFrame:
        return self.raw("customer").select(
            F.floor(F.col("c_custkey") / 3).cast("long").alias("developer_id"), F.col("c_mktsegment").alias("tag")
        ).distinct()

    # --- scans and their facts -------------------------------------------------

    def scans(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
        loc = F.when(key % 97 != 0, F.floor("o_totalprice").cast("long"))
        day = F.col("o_orderdate").cast("timestamp")
        return (
            self.raw("orders")
            .join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                key.alias("id"),
                F.col("c_nationkey").cast("long").alias(PR),
                status.alias("status"),
                F.when(key % 5 != 0, F.concat(F.lit("release/"), (key % 3).cast("string"))).alias("branch"),
                F.when(key % 4 == 0, F.concat(F.lit("abc"), key.cast("string"))).alias("commit_sha"),
                loc.alias("total_loc"),
                (F.col("o_custkey") % 1000).alias("total_files"),
                (loc * 40).alias("size_bytes"),
                F.when(key % 6 == 0, "library").when(key % 6 == 1, "monolith").when(key % 6 == 2, "backend_service").alias("project_type"),
                F.when(key % 3 == 0, "Python").when(key % 3 == 1, "Go").alias("primary_language"),
                F.when(key % 4 == 0, '["React", "Express"]').when(key % 4 == 1, '["Django"]').when(key % 4 == 2, "[]").otherwise("not json").alias("frameworks_json"),
                F.when(key % 3 == 0, '["npm", "pip"]').when(key % 3 == 1, '["pip"]').alias("package_managers_json"),
                F.when(key % 2 == 0, '["terraform"]').otherwise('["terraform", "helm"]').alias("infra_tools_json"),
                F.when(key % 2 == 0, '["Ruff"]').alias("linters_json"),
                F.when(key % 3 == 0, "gitlab").when(key % 3 == 1, "jenkins").alias("ci_provider"),
                (key % 2 == 0).alias("has_docker"),
                (key % 3 == 0).alias("has_kubernetes"),
                (key % 5 == 0).alias("has_terraform"),
                F.when(F.col("o_orderstatus") != "P", day).alias("started_at"),
                F.when(F.col("o_orderstatus") == "F", day + F.make_interval(hours=(key % 72).cast("int"))).alias("completed_at"),
                day.alias("created_at"),
            )
        )

    def lines(self) -> DataFrame:
        """Order lines with their part, as counts."""
        return self.raw("lineitem").join(
            self.raw("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
            F.col("l_partkey") == F.col("p_partkey"),
        ).select(
            "l_orderkey", "l_partkey", "l_suppkey",
            F.col("l_linenumber").cast("long").alias("l_linenumber"),
            F.col("l_quantity").cast("long").alias("qty"),
            "l_returnflag", "l_linestatus", "l_shipdate", "p_name", "p_brand", "p_type",
            F.col("p_size").cast("long").alias("p_size"),
        )

    def scan_languages(self) -> DataFrame:
        from .functions.common import with_share

        rows = self.lines().groupBy(F.col("l_orderkey").alias("scan_id"), F.col("p_brand").alias("language")).agg(
            F.count("*").alias("file_count"), (F.sum("qty") * 10).alias("loc")
        )
        return with_share(rows, ["scan_id"], "loc")

    def scan_scores(self) -> DataFrame:
        key = F.col("o_orderkey")
        overall = F.when(key % 11 != 0, (F.floor("o_totalprice").cast("long") % 1000) / 10.0)
        code = F.when(key % 3 != 0, (F.col("o_custkey") % 100).cast("double"))
        both = F.array(
            F.struct(F.lit("overall").alias("domain"), overall.cast("double").alias("score")),
            F.struct(F.lit("code_quality").alias("domain"), code.alias("score")),
        )
        return self.raw("orders").select(key.alias("scan_id"), F.inline(both)).filter(F.col("score").isNotNull())

    def scan_risks(self) -> DataFrame:
        n = F.col("l_linenumber")
        severity = F.when(n % 4 == 0, "critical").when(n % 4 == 1, "high").when(n % 4 == 2, "medium").otherwise("low")
        return self.lines().select(
            (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("id"),
            F.col("l_orderkey").alias("scan_id"),
            F.concat_ws("_", F.lit("risk"), "l_returnflag", "l_linestatus").alias("risk_type"),
            severity.alias("severity"),
            F.concat(F.lit("Risk in "), "p_name").alias("title"),
        )

    def contributions(self) -> DataFrame:
        """Per scan and profile. Days and parts are counted by their first line: distinct counts would
        write every line three times, or keep all of them in two tables in memory. The lines are dealt
        once, by scan, for all steps and for joins by scan that follow."""
        keys = ["l_orderkey", "l_suppkey"]

        def first(column: str, order: str) -> Column:
            in_order = Window.partitionBy(*keys, column).orderBy(order)
            return F.when(F.row_number().over(in_order) == 1, F.col(column))

        lines = self.lines().select(*keys, "l_partkey", "l_shipdate", "qty", "l_linenumber").repartition("l_orderkey")
        return lines.withColumn("day", first("l_shipdate", "l_partkey")).withColumn("part", first("l_partkey", "l_shipdate")).groupBy(
            F.col("l_orderkey").alias("scan_id"), F.col("l_suppkey").alias("profile_id")
        ).agg(
            F.count("*").alias("commit_count"),
            F.sum("qty").alias("insertions"),
            F.sum("l_linenumber").alias("deletions"),
            F.count("part").alias("files_changed"),
            F.count("day").alias("active_days"),
            F.min("l_shipdate").alias("first_commit_at"),
            F.max("l_shipdate").alias("last_commit_at"),
        )

    def language_contributions(self) -> DataFrame:
        return self._contributed("p_brand", "language")

    def module_contributions(self) -> DataFrame:
        scans = self.scans().select(F.col("id").alias("scan_id"), PR)
        rows = self._contributed("p_type", "module_path").join(scans, "scan_id")
        return rows.withColumn("module_id", module_id(F.col(PR), F.col("module_path"))).drop("module_path", PR)

    def _contributed(self, column: str, name: str) -> DataFrame:
        from .functions.common import with_share

        keys = ["scan_id", "profile_id"]
        rows = self.lines().groupBy(
            F.col("l_orderkey").alias("scan_id"), F.col("l_suppkey").alias("profile_id"), F.col(column).alias(name)
        ).agg(
            F.count("*").alias("commit_count"), F.count("*").alias("files_changed"),
            F.sum("qty").alias("loc_added"), F.sum("l_linenumber").alias("loc_deleted"),
        )
        return with_share(rows, keys, "files_changed")

    def modules(self) -> DataFrame:
        scans = self.scans().select(F.col("id").alias("l_orderkey"), PR)
        return self.lines().select("l_orderkey", "p_type").join(scans, "l_orderkey").select(PR, "p_type").distinct().select(
            module_id(F.col(PR), F.col("p_type")).alias("id"),
            PR,
            F.col("p_type").alias("path"),
            F.lower("p_type").alias("name"),
        )

    def dependencies(self) -> DataFrame:
        k, s = F.col("l_partkey"), F.col("p_size")
        spdx = case(k % 12, [
            "MIT", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "BSD-3-Clause",
            "AGPL-3.0-only", "CDDL-1.0", "GPL-9.9", "EUPL-1.2",
        ])
        risk = case(k % 12, ["safe", "safe", "risky", "risky", "safe", "safe", "risky", "unknown", "risky", "risky"])
        return self.lines().select(
            F.col("l_orderkey").alias("scan_id"),
            F.col("p_name").alias("name"),
            s.cast("string").alias("version"),
            F.when(F.col("l_returnflag") == "A", "prod").when(F.col("l_returnflag") == "N", "dev").otherwise("test").alias("dep_type"),
            F.concat(F.lower("p_type"), F.lit(".lock")).alias("manifest_file"),
            F.lower("p_type").alias("ecosystem"),
            F.when(s % 3 == 0, F.lit("tool")).alias("package_manager"),
            spdx.alias("license_spdx"),
            F.when((k % 12 == 10) | spdx.isNotNull(), F.concat(F.lit("raw "), (k % 12).cast("string"))).alias("license_raw"),
            F.coalesce(risk, F.lit("unknown")).alias("license_risk"),
            (F.col("l_linestatus") == "O").alias("is_direct"),
            F.when(k % 12 == 1, "Apache-2.0 OR MIT").alias("license_expression"),
            F.when(k % 5 == 0, "low").otherwise("high").alias("license_confidence"),
            F.when(k % 2 == 0, "lockfile").alias("license_source"),
            F.when(k % 10 == 0, "Ambiguous, see file").alias("license_notes"),
            F.when(s % 2 == 0, "locked").otherwise("declared_only").alias("discovery_mode"),
            (s % 7 == 0).alias("is_optional_dependency"),
            (s % 11 == 0).alias("is_private"),
        )

    def findings(self) -> DataFrame:
        return self.lines().select(
            F.col("l_orderkey").alias("scan_id"),
            F.when(F.col("l_returnflag") == "A", "email").when(F.col("l_returnflag") == "N", "phone").otherwise("inn").alias("pdn_type"),
            F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "p_name", F.lit(".py")).alias("file_path"),
            F.col("qty").alias("line_number"),
            F.concat(F.lit("id_"), "l_linestatus").alias("matched_identifier"),
        )

    # --- history ---------------------------------------------------------------

    def repository_daily(self) -> DataFrame:
        return self.scans().groupBy(PR, F.to_date("created_at").alias("commit_date")).agg(
            F.count("*").alias("commit_count")
        )

    def developer_daily(self) -> DataFrame:
        return self.raw("events").groupBy(
            F.col("user_id").alias("profile_id"), F.to_date("ts").alias("commit_date")
        ).agg(F.count("*").alias("commit_count"))

    def change_rows(self) -> DataFrame:
        """File changes, one per order line."""
        s = F.col("p_size")
        ext = case(s % 6, [".py", ".js", ".java", ".go", ".md"], ".zzz")
        name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), ext)
        return self.lines().select(
            F.col("l_orderkey").alias("sha_key"),
            F.when(s % 13 == 0, name).otherwise(F.concat(F.lower("p_type"), F.lit("/"), name)).alias("path"),
            F.col("qty").alias("insertions"),
            F.col("l_linenumber").alias("deletions"),
        )

    def commits(self) -> DataFrame:
        """Orders as commits, their lines as nested changes (a handful per order)."""
        from .functions.paths import detect_language

        change = F.struct("path", "insertions", "deletions", detect_language(F.col("path")).alias("language"))
        changes = self.change_rows().groupBy("sha_key").agg(F.collect_list(change).alias("file_changes"))
        key = F.col("o_orderkey")
        offset = case(key % 3, ["+03:00", "-05:00"], "+00:00")
        ts_raw = F.concat(
            F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"),
            F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":30:00"), offset,
        )
        empty = F.array().cast("array<struct<path:string,insertions:bigint,deletions:bigint,language:string>>")
        return (
            self.raw("orders")
            .join(self.raw("customer").select("c_custkey", "c_nationkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
            .join(changes, F.col("sha_key") == key, "left")
            .select(
                F.col("c_nationkey").cast("long").alias("repo_id"),
                (F.datediff(F.lit("2100-01-01"), F.col("o_orderdate")).cast("long") * 100_000_000_000 + key).alias("seq"),
                F.lpad(key.cast("string"), 12, "0").alias("sha"),
                F.col("c_name").alias("author_name"),
                F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("dev.team"), (F.col("o_custkey") % 200).cast("string"), F.lit("@example.com"))).alias("author_email"),
                ts_raw.alias("ts_raw"),
                F.to_timestamp(ts_raw).alias("ts"),
                F.coalesce("file_changes", empty).alias("file_changes"),
            )
        )

    # --- files -----------------------------------------------------------------

    def source_files(self) -> DataFrame:
        """Documents as files: the folder and the extension follow from the number."""
        k = F.col("doc_id")
        folder = case(k % 11, ["src/", "tests/", "", "docs/", "node_modules/x/", "lib/core/", ".github/", "app/", "pkg/spec/"], "src/main/")
        ext = case(k % 9, [".py", ".js", ".md", ".java", ".go", ".sql", ".txt", ".rb"], ".yaml")
        stem = F.when(k % 17 == 0, "README").when(k % 19 == 0, F.concat(F.lit("test_"), k.cast("string"))).otherwise(F.concat("lang", F.lit("_"), k.cast("string")))
        return self.raw("documents").select(
            F.col("source").alias("repo_id"),
            F.concat(folder, F.col("lang"), F.lit("/"), stem, ext).alias("path"),
            F.col("n_chars").alias("size_bytes"),
            F.col("text").alias("content"),
        )


def case(key: Column, values: list[str], otherwise: str | None = None) -> Column:
    """Value number `key` of a list."""
    c = F.lit(otherwise).cast("string")
    for i, v in enumerate(values):
        c = F.when(key == i, v).otherwise(c)
    return c


def module_id(pr: Column, path: Column) -> Column:
    return (pr * 100 + F.length(path) * 10 + F.instr(path, "A")).cast("long")

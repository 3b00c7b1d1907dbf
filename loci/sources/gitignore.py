"""Which files ignore rules leave: rules become regexes, matched by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import text as tx


def parse_rules(ignore_files: DataFrame) -> DataFrame:
    """Rules of ignore files (base, content), base being the folder ('' = root).

    (base, rule_no, negated, dir_only, regex); the regex is for a path
    relative to base.  In a file's own path, folder-only rules see its folders.
    """
    line = ignore_files.select("base", F.posexplode(F.split("content", "\n", -1)).alias("rule_no", "raw"))
    p = tx.strip(F.col("raw"))
    line = line.withColumn("p", p).where((F.col("p") != "") & ~F.col("p").startswith("#"))
    line = line.withColumn("p", F.when(F.rlike("p", F.lit(r"^\\[#!]")), F.substring("p", 2, 1 << 30)).otherwise(F.col("p")))
    line = line.withColumn("negated", F.col("p").startswith("!")).withColumn("p", F.regexp_replace("p", "^!", ""))
    line = line.withColumn("anchored", F.col("p").startswith("/")).withColumn("p", F.regexp_replace("p", "^/+", ""))
    line = line.withColumn("dir_only", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/+$", ""))
    line = line.where(F.col("p") != "")
    parts = F.split("p", "/", -1)
    rooted = F.col("anchored") | (F.size(parts) > 1)
    # From the base: whole path parts, one after the other; what follows is free.
    step = F.transform(parts, lambda q: F.when(q == "**", F.lit("(?:[^/]+(?:/|$))*")).otherwise(F.concat(glob_regex(q), F.lit("(?:/|$)"))))
    anywhere = F.concat(F.lit("(?:^|/)"), glob_regex(F.col("p")), F.lit("(?:/|$)"))
    return line.select(
        "base", "rule_no", "negated", "dir_only",
        F.when(rooted, F.concat(F.lit("^"), F.array_join(step, ""))).otherwise(anywhere).alias("regex"),
    )


def glob_regex(c: Column) -> Column:
    """* and ? stay within a path part; [..] is taken as it stands."""
    # Bracket sets are kept, everything else special is escaped.
    sets = F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\])"), F.lit(1))
    rest = F.split(c, r"\[[^\]]*\]", -1)
    escaped = F.transform(rest, lambda r: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(r, r"([.+^${}()|\\\[\]])", r"\\$1"), r"\*", "[^/]*"), r"\?", "[^/]"
    ))
    return F.array_join(F.transform(escaped, lambda r, i: F.concat(r, F.coalesce(F.get(sets, i), F.lit("")))), "")


def decisions(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Per entry (path, is_dir): ignored true, false (kept by negation), null (no rule).

    Entries meet the rules of their own ancestor folders by an equi-join; the
    deepest folder's last matching rule decides.
    """
    parts = F.split("path", "/")
    bases = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = entries.select("path", "is_dir", F.explode(bases).alias("base"))
    met = asked.join(rules, "base")
    rel = F.when(F.col("base") == "", F.col("path")).otherwise(F.substring("path", F.length("base") + 2, F.lit(1 << 30)))
    # A folder-only rule looks at the folders of a file, at a folder itself too.
    target = F.when(F.col("dir_only") & ~F.col("is_dir"), F.regexp_replace(rel, r"(^|/)[^/]*$", "")).otherwise(rel)
    hit = met.where((target != "") & F.rlike(target, F.col("regex")))
    last = hit.groupBy("path", "is_dir").agg(F.max_by(~F.col("negated"), F.struct(F.length("base"), "rule_no")).alias("ignored"))
    return entries.select("path", "is_dir").distinct().join(last, ["path", "is_dir"], "left")


def _forced(path: Column, include: list[str]) -> Column:
    """The path is an included one, lies below it, or leads to it."""
    out = F.lit(False)
    for inc in include:
        out = out | (path == inc) | path.startswith(inc + "/") | F.lit(inc).startswith(F.concat(path, F.lit("/")))
    return out


def include_list(paths) -> list[str]:
    return sorted({p for p in (str(x).strip().strip("/") for x in (paths or [])) if p})


def kept_files(
    files: DataFrame, rules: DataFrame | None, *, extensions, skip_dirs=(), skip_names=(), include=None,
) -> DataFrame:
    """Files (path relative to the project) that a project scan takes.

    A folder that is skipped or ignored takes everything below it along,
    unless it is included by name.
    """
    include = include_list(include)
    parts = F.split("path", "/")
    ext = tx.extension(F.col("path"))
    name = F.element_at(parts, -1)
    forced = _forced(F.col("path"), include)
    exact = F.col("path").isin(include) if include else F.lit(False)
    files = files.where((forced | ~name.isin(list(skip_names))) & (ext.isin(list(extensions)) | exact))
    # Folders of the files, each judged once.
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = F.when(F.size(parts) > 1, ancestors).otherwise(F.array().cast("array<string>"))
    pairs = files.select("path", F.explode(ancestors).alias("dir"))
    dirs = pairs.select(F.col("dir").alias("path")).distinct().withColumn("is_dir", F.lit(True))
    dname = tx.basename(F.col("path"))
    dirs = dirs.withColumn("_skip", dname.isin(list(skip_dirs)) | dname.endswith(".egg-info"))
    entries = dirs.select("path", "is_dir").unionByName(files.select("path", F.lit(False).alias("is_dir")))
    if rules is None:
        judged = entries.withColumn("ignored", F.lit(None).cast("boolean"))
    else:
        judged = decisions(entries, rules)
    judged = judged.join(dirs.select("path", "is_dir", "_skip"), ["path", "is_dir"], "left")
    bad = judged.where(
        (F.coalesce("ignored", F.lit(False)) | F.coalesce("_skip", F.lit(False))) & ~_forced(F.col("path"), include)
    )
    lost = pairs.join(bad.where("is_dir").select(F.col("path").alias("dir")), "dir", "left_semi").select("path").distinct()
    gone = bad.where(~F.col("is_dir")).select("path").unionByName(lost)
    return files.join(gone, "path", "left_anti")

"""Rules over a library (composers, people, workGroups, works, recordings): what is missing, wrong or suspicious. Each rule is a select of
the rows that break it; rows of keys that are null break no reference rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names, rules
from shelfmark.functions.text import trimmed

from . import display, people as persons

GARBLED = r"\?{3,}|\x{FFFD}"
NO_SUMMARY = ("", "暂无简介", "暂无简介。")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def no_summary(c: Column) -> Column:
    return trimmed(c).isin(*NO_SUMMARY) | trimmed(c).rlike(GARBLED)


def data_issues(lib: dict[str, DataFrame]) -> DataFrame:
    """entity_type, entity_id, category, message."""

    def issue(df: DataFrame, kind: str, category: str, *message: Column | str) -> DataFrame:
        text = F.concat(*(F.lit(m) if isinstance(m, str) else F.coalesce(m, F.lit("")) for m in message))
        return df.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.lit(category).alias("category"), text.alias("message"))

    shown = lambda df: df.withColumn("d", names.display(F.col("name"), F.col("nameLatin"), F.col("aliases")))
    primary = F.col("d.primary")
    unnamed = (F.col("d.full") == "") | (F.col("d.latin") == "")
    one_name = (primary != "") & (primary == F.col("d.full")) & (F.length(primary) <= 3)
    parts = []
    for kind, table in (("composer", "composers"), ("person", "people")):
        each = shown(lib[table])
        parts.append(issue(each.filter(unnamed), kind, "name-normalization", f"{kind} ", primary, " missing canonical full name or latin name"))
        parts.append(issue(each.filter(one_name), kind, "name-normalization", f"{kind} ", primary, " has no distinct short/full Chinese names"))
    c, p = shown(lib["composers"]), shown(lib["people"])
    parts.append(issue(c.filter(trimmed(F.col("country")) == ""), "composer", "country-missing", "composer ", primary, " missing country"))
    parts.append(issue(c.join(lib["works"].select(F.col("composerId").alias("id")), "id", "left_anti"), "composer", "relation-missing", "composer ", primary, " has no linked works"))
    parts.append(issue(p.filter("birthYear <> 0 AND deathYear <> 0 AND birthYear > deathYear"), "person", "year-conflict", "person ", primary, " has conflicting birth/death years"))
    parts.append(issue(p.filter(no_summary(F.col("summary"))), "person", "summary-missing", "person ", primary, " missing usable summary"))
    countries = names.distinct(F.concat(F.coalesce("countries", names.none()), F.array("country")))
    parts.append(issue(p.filter(F.size(countries) == 0), "person", "country-missing", "person ", primary, " missing country"))
    w, title = lib["works"], trimmed(F.col("title"))
    parts.append(issue(w.join(lib["recordings"].select(F.col("workId").alias("id")), "id", "left_anti"), "work", "relation-missing", "work ", title, " has no linked recordings"))
    parts.append(issue(w.filter(no_summary(F.col("summary"))), "work", "summary-missing", "work ", title, " missing usable summary"))
    r = lib["recordings"]
    known = w.select(F.col("id").alias("workId"))
    parts.append(issue(r.join(known, "workId", "left_anti"), "recording", "relation-missing", "recording ", title, " has no linked work"))
    roles = lib["people"].select(F.col("id").alias("_person"), "roles")
    credit = r.select("id", "title", F.explode("credits").alias("c")).filter(trimmed(F.col("c.displayName")) != "").withColumn("pid", trimmed(F.col("c.personId")))
    credit = credit.join(roles, F.col("pid") == F.col("_person"), "left")
    name, role = trimmed(F.col("c.displayName")), F.col("c.role")
    parts.append(issue(credit.filter("pid = ''"), "recording", "relation-missing", "recording ", title, " has an unlinked ", role, " credit for ", name))
    parts.append(issue(credit.filter("pid <> '' AND _person IS NULL"), "recording", "relation-missing", "recording ", title, " references a missing linked person ", F.col("pid")))
    said = F.coalesce(F.nullif(F.array_join("roles", "/"), F.lit("")), F.lit("unknown"))
    parts.append(issue(credit.filter("_person IS NOT NULL").filter(~names.fits_role(role, F.col("roles"))), "recording", "relation-mismatch", "recording ", title, " links ", name, " as ", role, " but person roles are ", said))
    return _union(parts)


def _plain_placeholder(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(*names.PLACEHOLDERS)


def audit(lib: dict[str, DataFrame], hints: DataFrame | None = None) -> DataFrame:
    """code, severity, entity_type, entity_id, detail, hint. hints: recordingId, resolutionHint, waivedMissingRoles.

    detail is what the rule found; hint says whether a recording can be mended from the page that it came from."""

    def issue(df: DataFrame, code: str, severity: str, kind: str, detail: Column, hint: Column | None = None) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), detail.alias("detail"), (F.lit(None).cast("string") if hint is None else hint).alias("hint"))

    name = lambda: trimmed(F.col("name"))
    blank = (trimmed(F.col("id")) == "person-item") | _plain_placeholder(F.col("name"))
    named = F.coalesce(F.nullif(trimmed(F.col("name")), F.lit("")), F.col("id"))
    parts = [issue(lib["composers"].filter(blank), "placeholder-entity", "error", "composer", named), issue(lib["people"].filter(blank), "placeholder-entity", "error", "person", named)]
    r = lib["recordings"]
    empty = F.filter("credits", lambda c: (trimmed(c["personId"]) == "person-item") | _plain_placeholder(c["displayName"]))
    first = F.get(empty, 0)
    parts.append(issue(r.filter(F.size(empty) > 0), "placeholder-entity", "error", "recording", F.coalesce(F.nullif(trimmed(first["displayName"]), F.lit("")), trimmed(first["personId"]))))
    p = lib["people"]
    parts.append(issue(p.filter(names.is_composite(F.col("name"), F.col("roles"))), "person-suspicious-ensemble-name", "warning", "person", name()))
    polluted = p.filter(names.is_polluted(F.col("slug"), F.col("roles"))).join(persons.group_replacements(p), "id", "left")
    parts.append(issue(polluted, "person-polluted-group-identity", "warning", "person", F.coalesce("replacement", F.lit(""))))
    day, place = trimmed(F.col("performanceDateText")), trimmed(F.col("venueText"))
    found = F.array_compact(F.array(
        F.when(day == "*", "performanceDateText contains placeholder '*'").when((day != "") & ~day.rlike("[0-9]") & (place == ""), F.concat(F.lit("performanceDateText looks like venue text: "), day)),
        F.when(place == "*", "venueText contains placeholder '*'"),
    ))
    parts.append(issue(r.filter(F.size(found) > 0), "recording-suspicious-metadata", "warning", "recording", F.array_join(found, "; ")))
    parts.append(missing_credits(lib, hints).select("code", "severity", "entity_type", "entity_id", F.array_join("missing", ", ").alias("detail"), "hint"))
    w = lib["works"].select(F.col("id").alias("workId"), F.col("title").alias("_t"), F.col("titleLatin").alias("_l"), "groupIds")
    groups = w.select("workId", F.explode("groupIds").alias("g")).join(lib["workGroups"].select(F.col("id").alias("g"), F.concat(F.array("title"), "path").alias("x")), "g").groupBy("workId").agg(F.flatten(F.collect_list("x")).alias("more"))
    typed = w.join(groups, "workId", "left").select("workId", rules.work_type_of_texts(F.concat(F.array("_t", "_l"), F.coalesce("more", names.none()))).alias("told"))
    kind = rules.work_type(F.col("workTypeHint"))
    conflict = r.join(typed, "workId", "left").withColumn("told", F.coalesce("told", F.lit("unknown"))).filter((kind != "unknown") & (F.col("told") != "unknown") & (F.col("told") != kind))
    parts.append(issue(conflict, "recording-work-type-conflict", "warning", "recording", F.concat(kind, F.lit(" / "), F.col("told"))))
    structured = r.filter(trimmed(F.col("title")).rlike("[|/-]"))
    titles = display.recording_displays(structured, p).select("id", F.col("title").alias("_shown"))
    stored, told = names.search_text(F.col("title")), names.search_text(F.col("_shown"))
    parts.append(issue(structured.join(titles, "id").filter((stored != "") & (told != "") & (stored != told)), "recording-title-credit-mismatch", "warning", "recording", F.col("_shown")))
    return _union(parts)


def missing_credits(lib: dict[str, DataFrame], hints: DataFrame | None = None) -> DataFrame:
    """Recordings that lack a role of their family, without the roles that a hint waives."""
    r = lib["recordings"].withColumn("_n", rules.count_roles(F.col("credits")))
    r = r.withColumn("_missing", rules.missing_roles(rules.family(F.col("workTypeHint"), F.col("_n")), F.col("_n")))
    if hints is not None:
        h = hints.select(F.col("recordingId").alias("id"), F.col("resolutionHint").alias("_hint"), F.transform(F.coalesce("waivedMissingRoles", names.none()), trimmed).alias("_waived"))
        r = r.join(h, "id", "left").withColumn("_missing", F.array_except("_missing", F.coalesce("_waived", names.none())))
    said = F.col("_hint") if hints is not None else F.lit(None).cast("string")
    hint = F.coalesce(F.nullif(said, F.lit("")), F.when(trimmed(F.col("legacyPath")) != "", "auto-fixable").otherwise("manual-backfill"))
    return r.filter(F.size("_missing") > 0).select(
        F.lit("recording-missing-credit-role").alias("code"), F.lit("error").alias("severity"), F.lit("recording").alias("entity_type"), F.col("id").alias("entity_id"), F.col("_missing").alias("missing"), hint.alias("hint"),
        "workId", rules.work_type(F.col("workTypeHint")).alias("kind"), trimmed(F.col("legacyPath")).alias("source_path"),
    )


def backfill_queue(lib: dict[str, DataFrame], hints: DataFrame | None = None) -> DataFrame:
    """composer_id, work_id, composer_name, work_title, item_count, recordings (sorted): recordings to complete by hand, by work. Works that
    are not known, or whose composer is not, are left out."""
    w = lib["works"].select(F.col("id").alias("workId"), F.col("composerId").alias("composer_id"), trimmed(F.col("title")).alias("work_title"))
    c = lib["composers"].select(F.col("id").alias("composer_id"), trimmed(F.col("name")).alias("composer_name"))
    due = missing_credits(lib, hints).filter("hint = 'manual-backfill'").join(w, "workId").join(c, "composer_id")
    return due.groupBy("composer_id", F.col("workId").alias("work_id"), "composer_name", "work_title").agg(F.count("*").alias("item_count"), F.array_sort(F.collect_list("entity_id")).alias("recordings"))


def violations(lib: dict[str, DataFrame]) -> DataFrame:
    """rule, id: what makes a library invalid: ids that repeat, references that lead nowhere, groups of another composer, images without a source."""
    from .audit import duplicate_keys, missing_parents

    composers = lib["composers"]
    parts = [duplicate_keys(lib[n], "id", f"{n}.id") for n in ("composers", "people", "workGroups", "works", "recordings")]
    parts.append(missing_parents(lib["workGroups"], ["id"], "composerId", composers, "id", "workGroups.composerId"))
    parts.append(missing_parents(lib["works"], ["id"], "composerId", composers, "id", "works.composerId"))
    each = lib["works"].select("id", "composerId", F.explode("groupIds").alias("group"))
    parts.append(missing_parents(each, ["id"], "group", lib["workGroups"], "id", "works.groupIds"))
    other = each.join(lib["workGroups"].select(F.col("id").alias("group"), F.col("composerId").alias("_of")), "group").filter("composerId <> _of")
    parts.append(other.select(F.lit("works.groupIds.composer").alias("rule"), F.col("id").cast("string").alias("entity_id")))
    parts.append(missing_parents(lib["recordings"], ["id"], "workId", lib["works"], "id", "recordings.workId"))
    credit = lib["recordings"].select("id", F.explode("credits.personId").alias("person")).filter("person <> ''")
    parts.append(missing_parents(credit, ["id"], "person", lib["people"], "id", "recordings.credits.personId"))
    return _union(parts)

"""Articles to labelled paragraphs.

Both kinds are window functions over lines. In the goals' articles the few states that a line can find (a list is open, a section has
begun, a target is told) follow from the lines before it by running aggregates.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import markup
from corpusloom.functions import patterns as P
from corpusloom.functions.regex import let, matches, replace, strip

LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1c-\x1e\x85\u2028\u2029]"
RARE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
PARAGRAPH_COLUMNS = ["goal", "target", "section", "source_url", "title", "revision_id", "revision_timestamp", "text"]
KEYS = ["file_ord", "page_ord"]


def _cut(text: Column) -> Column:
    """A text at its line ends; most texts know newlines only, where no pattern is needed."""
    return F.when(reduce(or_, (F.contains(text, F.lit(c)) for c in RARE_ENDS)), F.split(text, LINE_ENDS)).otherwise(F.split(text, "\n"))


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them."""
    return let([_cut(text)], lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))


def paragraph(goal: Column, target: Column, section: Column, text: Column) -> list[Column]:
    url = F.concat(F.lit(P.SOURCE_URL), F.replace(F.col("title"), F.lit(" "), F.lit("_")))
    return [goal.alias("goal"), F.lower(target).alias("target"), section.alias("section"), url.alias("source_url"), F.col("title"), F.col("revision_id"), F.col("revision_timestamp"), strip(text).alias("text")]


def general_paragraphs(pages: DataFrame) -> DataFrame:
    """Lines inside the blocks that headings of goals open, with the goal of the last heading above."""
    lines = pages.select(*KEYS, "title", "revision_id", "revision_timestamp", F.posexplode(split_lines(F.col("text"))).alias("emit_ord", "line"))
    line, head = F.col("line"), "==== Goal "
    opens = line.startswith(head)
    colon = F.locate(":", line)
    goal = F.when(colon == 0, F.raise_error(F.concat(F.lit("No colon in heading: "), line)).cast("string")).otherwise(F.substring(line, F.lit(len(head) + 1), F.greatest(colon - len(head) - 1, F.lit(0))))
    closes = ~opens & matches(line, r"^===[\sA-Z]")
    mark = F.when(opens, goal).when(closes, "")
    above = Window.partitionBy(*KEYS).orderBy("emit_ord")
    current = F.last("mark", ignorenulls=True).over(above)
    seen = lines.withColumn("mark", mark).withColumn("goal_now", current)
    body = seen.filter(F.col("mark").isNull() & (F.coalesce("goal_now", F.lit("")) != "") & (line != "") & ~matches(line, r"^\s+$"))
    return body.select(*KEYS, "emit_ord", *paragraph(F.col("goal_now"), F.lit(""), F.lit("General"), line))


# ---------------------------------------------------------------- articles on one goal

#: What follows a section: a heading of the second level, or the agencies.
NEXT_SECTION, AGENCIES = r"^==[\s\tA-Z].+$", "custodian agencies"
TARGET, TARGET_WORD = r"^===\s?target.+$", r"===\s?[tT]argets?\s"
_PAGE = [*KEYS, "title", "revision_id", "revision_timestamp"]
#: Bytes of text of the articles that one task has.
SLICE = 8_000_000
#: The part of the targets.
_LAST = len(P.SECTIONS) + 1


def _parts(pages: DataFrame) -> DataFrame:
    """A row for each line of each part of an article: part (0 the lead, then a number for each section's key, last the targets), key, i and line.

    A part begins at its first heading and has what follows; the lead ends with the first heading.
    """
    lines = pages.select(*_PAGE, F.posexplode(_cut(F.col("text"))).alias("i", "line")).withColumn("line", strip(F.col("line"))).filter("line != ''")
    line, low, page = F.col("line"), F.lower("line"), Window.partitionBy(*KEYS)
    first = lambda condition: F.min(F.when(condition, F.col("i"))).over(page)
    starts = {f"from{n}": first(_second_level(line) & F.contains(low, F.lit(key))) for n, key in enumerate(P.SECTIONS, 1)}
    placed = lines.withColumns({"lead_ends": first(line.startswith("=")), **starts, f"from{_LAST}": first(line.startswith("==="))})
    here = [F.when(F.col("lead_ends").isNull() | (F.col("i") <= F.col("lead_ends")), F.struct(F.lit(0).alias("part"), F.lit("").alias("key")))]
    here += [F.when(F.col("i") >= F.col(f"from{n}"), F.struct(F.lit(n).alias("part"), F.lit(key).alias("key"))) for n, key in enumerate([*P.SECTIONS, ""], 1)]
    return placed.select(*_PAGE, F.explode(F.array_compact(F.array(*here))).alias("p"), "i", "line").select(*_PAGE, "p.part", "p.key", "i", "line")


def _second_level(line: Column) -> Column:
    return line.startswith("== ") | line.startswith("==\t")


def _sections(lines: DataFrame) -> DataFrame:
    """fed (whether a list or paragraph reads the line) and name of the lines of named sections.

    A section ends at the next one's heading, or one line later where a list is open there.
    """
    line, low, key = F.col("line"), F.lower("line"), F.col("key")
    whole = Window.partitionBy(*KEYS, "part")
    named = (F.col("part") > 0) & (F.col("part") < _LAST)
    head = named & _second_level(line) & F.contains(low, key)
    ends = named & ~head & ((line.startswith("==") & matches(line, NEXT_SECTION) & ~F.contains(low, key)) | (line.startswith("===") & low.contains(AGENCIES)))
    marked = lines.withColumns({"head": head, "ends": ends, "cand": ~line.startswith("=="), "open": line.endswith("*") | line.endswith(":")})
    # the ordered window comes first, as its order serves the others
    marked = marked.withColumn("name", F.last(F.when(F.col("head"), strip(F.translate("line", "=\t", ""))), ignorenulls=True).over(whole.orderBy("i")))
    marked = marked.withColumn("end", F.min(F.when(F.col("ends"), F.col("i"))).over(whole))
    inside = F.col("cand") & (F.col("end").isNull() | (F.col("i") < F.col("end")))
    open_there = F.max(F.when(inside, F.struct("i", "open"))).over(whole)["open"]
    further = F.min(F.when(F.col("cand") & (F.col("i") > F.col("end")), F.col("i"))).over(whole)
    fed = F.coalesce(inside | (F.col("cand") & F.coalesce(open_there, F.lit(False)) & (F.col("i") == further)), F.lit(False))
    return marked.withColumn("fed", fed).drop("head", "ends", "cand", "open", "end")


def _found(mark: Column, text: Column, line: Column) -> Column:
    """Where the mark stands in a text, from 1; none is an error."""
    at = F.position(mark, text)
    return F.when(at == 0, F.raise_error(F.concat(F.lit("No mark in the heading of a target: "), line)).cast("int")).otherwise(at)


def _targets(lines: DataFrame) -> DataFrame:
    """of (label and text of the target that is open), seg (headings so far), segs (all of them), stop (where the targets end) and sect (a heading) of the last part's lines."""
    line, mine = F.col("line"), F.col("part") == _LAST
    whole = Window.partitionBy(*KEYS, "part")
    running = whole.orderBy("i")
    mark = F.when(F.contains(line, F.lit(":")), ":").otherwise(". ")
    rest, title = replace(line, TARGET_WORD), strip(F.replace(line, F.lit("="), F.lit("")))
    name = F.regexp_replace(strip(F.call_function("left", rest, _found(mark, rest, line) - 1)), r"\.\z", "")
    told = F.call_function("substring", title, _found(mark, title, line) + 1, F.char_length(title))
    opened = F.when(matches(line, TARGET, ignore_case=True), F.struct(name.alias("label"), strip(told).alias("told")))
    marked = lines.withColumn("sect", mine & line.startswith("==="))
    marked = marked.withColumn("opened", F.when(F.col("sect"), F.struct(opened.alias("of"))))
    marked = marked.withColumns({"of": F.last("opened", ignorenulls=True).over(running)["of"], "seg": F.count(F.when(F.col("sect"), 1)).over(running).cast("int")})
    marked = marked.withColumn("stop", F.min(F.when(mine & ~F.col("sect") & F.col("of").isNotNull() & line.startswith("== "), F.col("i"))).over(whole))
    return marked.withColumn("segs", F.max(F.when(F.col("stop").isNull() | (F.col("i") <= F.col("stop")), F.col("seg"))).over(whole)).drop("opened")


def _read(lines: DataFrame) -> DataFrame:
    """Lines that become paragraphs, with name, seg, label, after_heading, heads (only where a list is open before it) and told (a target's heading as a text)."""
    marked, lead, last = _targets(_sections(lines)), F.col("part") == 0, F.col("part") == _LAST
    open_still = F.col("of").isNotNull() & F.when(F.col("sect"), F.col("stop").isNull() | (F.col("i") <= F.col("stop"))).otherwise(F.col("stop").isNull() | (F.col("i") < F.col("stop")))
    kept = marked.filter(F.when(lead, True).when(last, open_still).otherwise(F.col("fed")))
    return kept.select(
        *_PAGE, "part", "i", "line", "seg", F.when(lead, "Lead section").when(last, "Targets").otherwise(F.col("name")).alias("name"), F.when(last, F.col("of.label")).otherwise("").alias("label"),
        (last & (F.col("seg") < F.col("segs"))).alias("after_heading"), (lead & F.col("line").startswith("=")).alias("heads"), F.when(F.col("sect"), F.col("of.told")).alias("told"),
    )


def _gathered(lines: DataFrame) -> DataFrame:
    """Lines as paragraphs, a list with the line before it as one. lines: as _read gives them.

    A line opens a list if it ends with a colon; in a section (stars come last there) one with a star does, too. A line with a star goes on with an open list.
    Whether a list is open after a line follows from the line alone, but for a star outside the sections, which leaves it as it is. A list is told once
    a line follows that isn't its own, or a target's heading does; else it is lost. A target's heading is a paragraph of its own, the first of its lines.
    """
    line, section, title = F.col("line"), (F.col("part") > 0) & (F.col("part") < _LAST), F.col("told").isNotNull()
    run = Window.partitionBy(*KEYS, "part", "seg").orderBy("i")
    item, colon = ~title & F.when(section, line.endswith("*")).otherwise(line.startswith("*")), ~title & line.endswith(":")
    state = F.when(title, None).when(colon, True).when(section, item).when(~item, False)
    rows = lines.withColumns({"item": item, "colon": colon, "state": F.last(state, ignorenulls=True).over(run)})
    rows = rows.withColumn("before", F.coalesce(F.lag("state").over(run), F.lit(False))).filter("not heads or before")
    goes_on = F.col("before") & F.col("item")
    entry = F.concat(F.replace(line, F.lit("*"), F.lit("")), F.lit(";; "))
    starred = section & F.col("item")
    rows = rows.withColumns({"goes_on": goes_on, "plain": ~goes_on & ~F.col("colon") & ~starred, "piece": F.when(goes_on | starred, entry).otherwise(F.coalesce("told", "line"))})
    rows = rows.withColumns({"g": F.count(F.when(~F.col("goes_on"), 1)).over(run), "next_name": F.lead("name").over(run)})
    pieces = F.array_sort(F.collect_list(F.struct("i", "piece")))
    grouped = rows.groupBy(*_PAGE, "part", "seg", "g").agg(
        F.min("i").alias("i"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"), F.max_by(F.struct("name", "next_name"), "i").alias("names"), F.max("plain").alias("plain"), F.max("label").alias("target"), F.max("after_heading").alias("after_heading"),
    )
    told = F.col("plain") | F.col("after_heading") | F.col("names.next_name").isNotNull()
    return grouped.filter(told).select(*_PAGE, "part", "i", "target", F.when(F.col("plain"), F.col("names.name")).otherwise(F.coalesce("names.next_name", "names.name")).alias("section"), "text")


def slices(pages: DataFrame) -> int:
    """Into how many tasks articles go, by the size of their texts."""
    return max(1, -(-(pages.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE))


def specific_paragraphs(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Lead section, named sections and targets of each goal's article.

    Each line of a part is a row, and what the lines before it have opened is told by windows over the page: one exchange by page, and
    work in proportion to its lines, however many it has. More articles make more tasks and not larger ones. tasks: as slices() tells from the pages, or from what
    they are made of.
    """
    dealt = pages.repartition(tasks or slices(pages), "page_ord")
    rows = _gathered(_read(_parts(dealt)))
    rows = rows.withColumn("emit_ord", F.row_number().over(Window.partitionBy(*KEYS).orderBy("part", "i")) - 1)
    goal = F.substring(F.col("title"), F.lit(len(P.TITLE_PREFIX) + 1), F.char_length("title"))
    return rows.select(*KEYS, "emit_ord", *paragraph(goal, F.col("target"), F.col("section"), F.col("text")))


def paragraphs(pages: DataFrame) -> DataFrame:
    """file_ord, page_ord, emit_ord and PARAGRAPH_COLUMNS of all articles, markup removed."""
    stripped = pages.withColumn("text", markup.strip_markup(F.col("text")))
    single = "not is_general"
    both = general_paragraphs(stripped.filter("is_general")).unionByName(specific_paragraphs(stripped.filter(single), slices(pages.filter(single))))
    return both.withColumn("text", markup.strip_links(F.col("text")))

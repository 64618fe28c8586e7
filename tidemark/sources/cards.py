"""Fight cards and totals from HTML: one tolerant pass in Arrow batches keeps the marked parts, expressions judge them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import outcomes, text

#: Class names and words of the pages (fixed values).
ROW_CLASSES = {"b-fight-details__table-row", "b-fight-details__table-row__hover"}
TEXT_CLASS, LEFT_CLASS, COLUMN_CLASS = "b-fight-details__table-text", "l-page_align_left", "b-fight-details__table-col"
PERSON, STATUS, PERSON_LINK = "b-fight-details__person", "b-fight-details__person-status", "b-fight-details__person-link"
GREEN_FLAG, GREEN = "b-flag_style_green", "style_green"
WEIGHT_HINTS = ("weight", "fly", "bantam", "feather", "light", "welter", "middle", "light heavy", "heavy", "women", "catch")

_ANCHOR = pa.struct([("href", pa.string()), ("text", pa.string())])
_ROW = pa.struct([("link", pa.string()), ("green", pa.bool_()), ("anchors", pa.list_(_ANCHOR)), ("left", pa.list_(pa.string())), ("cols", pa.list_(pa.string()))])
_TABLE = pa.struct([("head", pa.list_(pa.string())), ("people", pa.list_(_ANCHOR)), ("values", pa.list_(pa.list_(pa.string())))])
_PERSON = pa.struct([("green", pa.bool_()), ("href", pa.string())])
_PARTS = {"rows": pa.list_(_ROW), "tables": pa.list_(_TABLE), "persons": pa.list_(_PERSON)}
_DDL = (
    "rows array<struct<link:string,green:boolean,anchors:array<struct<href:string,text:string>>,left:array<string>,cols:array<string>>>, "
    "tables array<struct<head:array<string>,people:array<struct<href:string,text:string>>,values:array<array<string>>>>, persons array<struct<green:boolean,href:string>>"
)


class _Marks(HTMLParser):
    """Rows, tables and persons with the texts of their marked parts; what isn't closed ends where the next begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.tables, self.persons = [], [], []
        self.row = self.table = self.person = None
        self.body_rows = 0
        self.in_head = self.left = self.marked = False
        self.open: dict[str, list[str]] = {}  # texts being read, by the tag that ends them

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = set((attrs.get("class") or "").split())
        if tag == "table":
            self.table = {"head": [], "people": [], "values": []}
            self.tables.append(self.table)
            self.in_head, self.body_rows = False, 0
        elif tag in ("thead", "tbody"):
            self.in_head = tag == "thead"
        elif tag == "tr":
            self.open.clear()
            self.row = {"link": attrs.get("data-link") or "", "green": False, "anchors": [], "left": [], "cols": []}
            self.body_rows += not self.in_head
            if ROW_CLASSES <= classes:
                self.rows.append(self.row)
        elif tag == "th" and self.table and self.in_head:
            self.table["head"].append(self._begin("th"))
        elif tag == "td" and self.row:
            self.open.clear()
            self.left, self.marked = LEFT_CLASS in classes, False
            if COLUMN_CLASS in classes:
                self.row["cols"].append(self._begin("td"))
            if self.table and self.body_rows == 1:
                self.table["values"].append([])
        elif tag == "p":
            self.open.pop("p", None)
            self.marked = TEXT_CLASS in classes
            if self.marked and self.row:
                part = self._begin("p")
                if self.left:
                    self.row["left"].append(part)
                if self.table and self.table["values"] and self.body_rows == 1:
                    self.table["values"][-1].append(part)
        elif tag == "a":
            if self.person and PERSON_LINK in classes and self.person["href"] is None:
                self.person["href"] = attrs.get("href") or None
            if self.row:
                self.row["green"] |= GREEN_FLAG in classes
                anchor = {"href": attrs.get("href") or "", "text": self._begin("a")}
                self.row["anchors"].append(anchor)
                if self.table and self.body_rows == 1 and len(self.table["values"]) == 1 and self.marked:
                    self.table["people"].append(anchor)
        elif tag == "div" and PERSON in classes:
            self.person = {"green": None, "href": None}
            self.persons.append(self.person)
        elif tag == "i" and self.person and STATUS in classes and self.person["green"] is None:
            self.person["green"] = any(GREEN in c for c in classes)

    def _begin(self, tag: str) -> list[str]:
        self.open[tag] = []
        return self.open[tag]

    def handle_endtag(self, tag):
        self.open.pop(tag, None)
        if tag == "p":
            self.marked = False
        elif tag == "tr":
            self.open.clear()
            self.row = None
        elif tag == "table":
            self.row = self.table = None

    def handle_data(self, data):
        if piece := data.strip():
            for target in self.open.values():
                target.append(piece)


def _marks(html: str | None) -> dict:
    reader = _Marks()
    reader.feed(html or "")
    reader.close()
    anchor = lambda a: {"href": a["href"], "text": "".join(a["text"])}
    rows = [{**r, "anchors": [anchor(a) for a in r["anchors"]], "left": [" ".join(p) for p in r["left"]], "cols": ["".join(c) for c in r["cols"]]} for r in reader.rows]
    tables = [{"head": ["".join(h) for h in t["head"]], "people": [anchor(a) for a in t["people"]], "values": [["".join(p) for p in c] for c in t["values"]]} for t in reader.tables]
    return {"rows": rows, "tables": tables, "persons": reader.persons}


def read_marks(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, rows, tables, persons) of each page; a null or empty page has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_marks(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[c] for f in found], t) for c, t in _PARTS.items())], names=[key, *_PARTS])

    return df.select(key, html).mapInArrow(run, f"`{key}` {kind}, {_DDL}")


def id_of(url: Column) -> Column:
    """The last part of a link's path."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", ""), "/"), -1)


def weight_like(cell: Column) -> Column:
    return F.lower(cell).rlike("|".join(WEIGHT_HINTS))


def method_cell(texts: Column, names: Column) -> Column:
    """The first exact method of the cells, else the first that is no name, no weight class and not `W`; blank if none."""
    others = F.filter(texts, lambda t: (t != "") & ~F.coalesce(F.array_contains(names, outcomes.canonical_method(t)), F.lit(False)))
    exact = lambda t: outcomes.canonical_method(t).isin(*outcomes.METHOD_TOKENS)
    odd = F.filter(others, lambda t: ~exact(t) & (outcomes.canonical_method(t) != "W") & ~weight_like(t))
    return F.coalesce(F.get(F.filter(others, exact), 0), F.get(odd, 0), F.lit(""))


def fights(marks: DataFrame, key: str) -> DataFrame:
    """A row for each fight of a card, in the page's order (pos); rows without a link of a fight or two fighters are none."""
    r = marks.select(key, F.posexplode("rows").alias("pos", "r"))
    r = r.select(key, "pos", "r", F.filter("r.anchors", lambda a: a["href"].contains("fighter-details")).alias("f")).where(F.col("r.link").contains("fight-details") & (F.size("f") >= 2))
    a, b = F.get("f", 0), F.get("f", 1)
    n = F.size("r.cols")
    number, clock = F.get("r.cols", n - 2), F.get("r.cols", n - 1)
    names = F.array(outcomes.canonical_method(a["text"]), outcomes.canonical_method(b["text"]))
    return r.select(
        key, "pos", id_of(F.col("r.link")).alias("fight_id"), id_of(a["href"]).alias("fighter_a_id"), a["text"].alias("fighter_a_name"), id_of(b["href"]).alias("fighter_b_id"), b["text"].alias("fighter_b_name"),
        F.when(F.col("r.green"), id_of(a["href"])).alias("winner_id"), F.coalesce(F.get(F.filter("r.left", weight_like), 0), F.lit("")).alias("weight_class"), method_cell(F.col("r.left"), names).alias("method"),
        F.when((n >= 2) & number.rlike(r"^\d+$"), number.try_cast("int")).alias("round"), F.when((n >= 2) & (clock != ""), clock).alias("time"),
    )


def totals(marks: DataFrame, key: str) -> DataFrame:
    """Both fighters of a page's first table of totals: side 0 and 1. Cells that are absent or no count are 0, percentages null."""
    fits = lambda t: F.lower(F.coalesce(F.get(t["head"], 0), F.lit(""))).startswith("fighter") & F.array_contains(t["head"], "KD")
    t = marks.select(key, F.get(F.filter("tables", fits), 0).alias("t")).where((F.size("t.people") >= 2) & (F.size("t.values") >= 2))
    t = t.select(key, "t", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    cell = lambda k: F.coalesce(F.get(F.get("t.values", k), F.col("side")), F.lit(""))
    count = lambda k: F.coalesce(F.when(cell(k).rlike(r"^\d+$"), cell(k)).try_cast("int"), F.lit(0))
    who = F.get("t.people", F.col("side"))
    strikes, all_strikes, downs = (text.parse_of(cell(k)) for k in (2, 4, 5))
    return t.select(
        key, "side", id_of(who["href"]).alias("fighter_id"), who["text"].alias("name"), count(1).alias("kd"), strikes["landed"].alias("sig_landed"), strikes["attempted"].alias("sig_attempted"),
        text.parse_percent(cell(3)).alias("sig_pct"), all_strikes["landed"].alias("total_landed"), all_strikes["attempted"].alias("total_attempted"), downs["landed"].alias("td_landed"),
        downs["attempted"].alias("td_attempted"), text.parse_percent(cell(6)).alias("td_pct"), count(7).alias("sub_att"), count(8).alias("rev"), text.parse_clock(cell(9)).alias("ctrl_seconds"),
    )


def winners(marks: DataFrame, key: str) -> DataFrame:
    """(key, winner_id): the first person with a green mark and a link, null if none."""
    won = F.get(F.filter("persons", lambda p: F.coalesce(p["green"], F.lit(False)) & p["href"].isNotNull()), 0)
    return marks.select(key, id_of(won["href"]).alias("winner_id"))

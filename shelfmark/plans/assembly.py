"""The named query of assembling links, over candidates made from order lines, and its SQL: the stages as common table expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import assembly, shared

from .catalogue import query

_H = "(l_orderkey * {a} + l_linenumber * {b} + l_partkey * {k})"


def _h(a: int, b: int, k: int, m: int) -> str:
    return f"{_H.format(a=a, b=b, k=k)} % {m}"


#: Columns of candidates, in both dialects; items differ in how sure their candidates are.
_CANDIDATES = {
    "item": "l_partkey", "url": "concat('https://links.example/', l_orderkey, '/', l_linenumber)",
    "platform": f"CASE {_h(3, 5, 0, 6)} WHEN 0 THEN 'youtube' WHEN 1 THEN 'bilibili' WHEN 2 THEN 'apple_music' WHEN 3 THEN 'youtube' WHEN 4 THEN 'bilibili' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'spotify' ELSE '' END END",
    "confidence": f"CAST(45 + l_partkey % 8 * 3 + {_h(7, 11, 1, 24)} AS DOUBLE) / 100", "title_score": f"CAST({_h(13, 3, 5, 30)} - 8 AS DOUBLE) / 100", "match_score": f"CAST({_h(5, 17, 3, 40)} - 8 AS DOUBLE) / 100",
    "packaging": f"CAST({_h(11, 2, 7, 40)} - 20 AS DOUBLE) / 100", "zone": f"CASE WHEN {_h(1, 1, 1, 9)} = 0 THEN 'red' WHEN {_h(1, 1, 1, 9)} < 5 THEN 'green' ELSE 'yellow' END",
    "total": f"CAST({_h(7, 19, 2, 97)} AS DOUBLE) / 50", "exact": f"CAST({_h(17, 7, 4, 89)} AS DOUBLE) / 50", "seconds": f"CASE WHEN {_h(1, 2, 0, 5)} = 0 THEN NULL ELSE {_h(2, 3, 1, 40)} * 60 END",
    "movement": f"{_h(1, 3, 2, 6)} = 0", "conflict": f"{_h(3, 1, 2, 7)} = 0", "title_conflict": f"{_h(3, 1, 2, 7)} IN (0, 1)", "names_year": f"{_h(5, 1, 0, 4)} = 0", "context": f"{_h(1, 7, 3, 4)}", "independent": f"{_h(7, 3, 1, 11)} = 0",
    "version": f"{_h(3, 7, 1, 4)} < 2", "accepted": f"l_partkey % 3 = 0 AND {_h(9, 4, 1, 13)} = 0", "track": f"{_h(1, 1, 2, 2)} = 0",
}
_ITEMS = {
    "item": "p_partkey", "n_accepted": "CASE WHEN p_partkey % 3 = 0 THEN 1 + p_partkey % 4 ELSE 0 END", "sparse": "p_partkey % 4 = 1", "hint": "p_partkey % 5 = 2", "chamber": "p_partkey % 2 = 0", "chamber_solo": "p_partkey % 4 = 2",
    "has_years": "p_partkey % 3 <> 1", "has_context": "p_partkey % 5 <> 4", "dated": "p_partkey % 2 = 1",
}
#: Items have one to nine candidates.
_KEPT = "pos <= 1 + item % 9"


class _Stages:
    """Common table expressions that add to or replace columns of the one before; i and p are its windows by item and by item and platform."""

    def __init__(self) -> None:
        self.ctes, self.k = [], 0

    def put(self, **columns: str) -> None:
        new = [n for n in columns if n not in self.known]
        old = [n for n in columns if n in self.known]
        replaced = f" REPLACE ({', '.join(f'{columns[n]} AS {n}' for n in old)})" if old else ""
        added = "".join(f", {columns[n]} AS {n}" for n in new)
        self.k += 1
        self.ctes.append(f"s{self.k} AS (SELECT *{replaced}{added} FROM s{self.k - 1} WINDOW i AS (PARTITION BY item), p AS (PARTITION BY item, platform))")
        self.known |= set(columns)

    known: set[str] = set()

    def pick(self, want: str, order: str, over: str = "item", most: int = 1) -> None:
        self.put(want=f"coalesce(({want}) AND NOT chosen, false)")
        self.put(pick=f"want AND row_number() OVER (PARTITION BY {over} ORDER BY want DESC, {order} DESC, pos) <= {most}")

    def add(self, exact: str, flag: str = "nothing") -> None:
        self.put(came="coalesce(sum(pick::INT) OVER i, 0) > 0")
        self.put(by_exact=f"CASE WHEN came THEN {exact} ELSE by_exact END", chosen="chosen OR pick", **{flag: f"{flag} OR came"})

    def top(self) -> None:
        self.put(top="max({'o': " + _SORT + ", 'p': -pos, 'platform': platform, 'title': title_score, 'match': match_score, 'packaging': packaging, 'movement': movement, 'sure': confidence}) FILTER (chosen) OVER i", n=_n("chosen"))

    def cross(self, among: str, order: str) -> None:
        self.put(f="max({'o': " + order + ", 'p': -pos, 'platform': platform, 'title': title_score}) FILTER (" + among + ") OVER i", k=_n(among))
        self.put(nearby=f"({among}) AND platform <> '' AND platform <> f.platform AND confidence >= 0.65 AND title_score >= greatest(0.05::DOUBLE, f.title - 0.06::DOUBLE)")
        self.put(near_n="CASE WHEN nearby THEN count(*) FILTER (nearby) OVER p END")
        self.put(crossed="k >= 3 AND f.platform IN ('youtube', 'bilibili') AND coalesce(max(near_n) OVER i, 0) >= 2")

    def versions(self, pool: str) -> None:
        self.put(can=f"coalesce(({pool}) AND version AND NOT chosen, false)")
        self.put(led=f"can AND platform IN {_PRIMARY} AND row_number() OVER (PARTITION BY item, platform ORDER BY can DESC, exact DESC, pos) = 1", best_can="max({'o': exact, 'p': -pos, 'match': match_score}) FILTER (can) OVER i")
        self.put(leads="row_number() OVER (PARTITION BY item ORDER BY led DESC, exact DESC, pos)", has_led="bool_or(led) OVER i", like_can="can AND (-pos = best_can.p OR match_score >= best_can.match - 0.03::DOUBLE)")
        self.put(pick="coalesce(CASE WHEN has_led THEN led AND leads <= 3 ELSE like_can AND row_number() OVER (PARTITION BY item ORDER BY like_can DESC, exact DESC, pos) <= 2 END, false)")


_PRIMARY = "('bilibili', 'youtube', 'apple_music')"
_VIDEO = "('youtube', 'bilibili')"
_SORT = "CASE WHEN by_exact THEN exact ELSE total END"
_MODE = "CASE WHEN ambiguous THEN exact ELSE total END"
_OK = "NOT conflict AND zone <> 'red'"


def _n(cond: str, over: str = "i") -> str:
    return f"count(*) FILTER ({cond}) OVER {over}"


def _m(x: str, cond: str, over: str = "i") -> str:
    return f"max({x}) FILTER ({cond}) OVER {over}"


def _kinds(cond: str) -> str:
    return f"len(list_distinct(list(platform) FILTER ({cond}) OVER i))"


def _sql() -> str:
    s = _Stages()
    s.known = {*_CANDIDATES, *_ITEMS, "pos"}
    made = ", ".join(f"{e} AS {n}" for n, e in _CANDIDATES.items())
    order = "l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_quantity"
    s.ctes.append(f"s0 AS (SELECT * FROM (SELECT {made}, row_number() OVER (PARTITION BY l_partkey ORDER BY {order}) AS pos FROM lineitem) JOIN (SELECT {', '.join(f'{e} AS {n}' for n, e in _ITEMS.items())} FROM part) USING (item) WHERE {_KEPT})")
    # several uploads of one platform
    s.put(first="max({'o': total, 'p': -pos, 'platform': platform, 'sure': confidence}) OVER i", everyone="count(*) OVER i")
    s.put(close="platform = first.platform AND confidence >= greatest(0.65::DOUBLE, first.sure - CASE WHEN sparse THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END)")
    s.put(near_all=_n("close"), hits=_n("close AND title_score >= CASE WHEN sparse THEN 0.04 ELSE 0.05 END"), spread=f"{_m('title_score', 'close')} - min(title_score) FILTER (close) OVER i")
    s.put(ambiguous=f"everyone >= 3 AND first.platform IN {_VIDEO} AND near_all >= 3 AND ((hits >= 2 AND (spread >= 0.05::DOUBLE OR near_all >= 4)) OR hits >= 3)", chosen="confidence >= 0.65 OR accepted", nothing="false")
    s.put(c=_n("chosen"), most=_m("confidence", "chosen"), started=f"{_n('chosen')} > 0", by_exact="ambiguous", a="false", added_close="false", added_long="false", added_low="false")
    s.put(chosen="started AND (accepted OR confidence >= greatest(0.65::DOUBLE, most - CASE WHEN hint AND c >= 5 THEN 0.32::DOUBLE WHEN ambiguous AND sparse THEN 0.26::DOUBLE WHEN ambiguous THEN 0.18::DOUBLE ELSE 0.08::DOUBLE END))")
    # floors and filters
    s.put(c=_n("chosen"), kinds=_kinds("accepted AND platform <> ''"), kind=_m("platform", "accepted AND platform <> ''"), best=_m("title_score", "accepted"))
    s.put(pick="coalesce(started AND n_accepted > 0 AND c < 3 AND kinds = 1 AND NOT chosen AND platform = kind AND confidence >= 0.65 AND title_score >= best, false)")
    s.add("ambiguous")
    s.put(right_year="chosen AND (NOT title_conflict OR accepted)")
    s.put(chosen=f"CASE WHEN has_years AND {_n('right_year AND (accepted OR names_year)')} > 0 THEN right_year ELSE chosen END")
    s.put(c=_n("chosen"), best=_m("title_score", "chosen"))
    s.put(chosen="CASE WHEN ambiguous AND c >= 3 THEN chosen AND (accepted OR title_score >= greatest(CASE WHEN sparse THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END, best - 0.05::DOUBLE) - 1e-6::DOUBLE) ELSE chosen END")
    s.cross("true", "total")
    s.top()
    s.put(pick="coalesce(started AND n_accepted = 0 AND n < 3 AND crossed AND NOT chosen AND platform <> coalesce(top.platform, '') AND confidence >= 0.65 AND title_score >= greatest(0.05::DOUBLE, coalesce(top.title, 0::DOUBLE) - 0.06::DOUBLE), false)")
    s.add("ambiguous")
    s.put(held="chosen AND accepted")
    s.put(kinds=_kinds("held AND platform <> ''"), kind=_m("platform", "held AND platform <> ''"), best=_m("title_score", "held"), most=_m("confidence", "held"), c=_n("held"))
    s.put(alike="title_score >= best AND confidence <= most + 0.08::DOUBLE", one="c > 0 AND kinds = 1")
    s.put(close_alternate=f"one AND {_n('chosen AND NOT accepted AND platform = kind AND alike')} > 0", chosen="CASE WHEN one THEN chosen AND (accepted OR platform <> kind OR alike) ELSE chosen END")
    # rules that add
    mine = f"chosen AND platform IN {_PRIMARY}"
    held = f"held AND platform IN {_PRIMARY}"
    s.put(kinds=_kinds(mine), here=_n(mine, "p"), anchors=_kinds(held), inside=_n(f"{held} AND chosen"), best=_m("title_score", held), most=_m("confidence", held), ctx=_m("context", held))
    s.pick(f"kinds = 1 AND anchors = 1 AND inside > 0 AND has_context AND platform IN {_PRIMARY} AND here = 0 AND confidence >= greatest(0.55::DOUBLE, most - 0.28::DOUBLE) AND title_score >= greatest(0.04::DOUBLE, best - 0.02::DOUBLE) - 1e-6::DOUBLE AND context > ctx AND (NOT has_years OR NOT title_conflict)", _MODE, "item, platform")
    s.add("ambiguous")
    s.top()
    s.pick(f"n > 0 AND (top.packaging < -0.08 OR top.movement) AND platform IN {_PRIMARY} AND confidence >= 0.5 AND {_OK} AND NOT movement AND packaging >= greatest(0::DOUBLE, top.packaging + 0.08::DOUBLE) AND match_score >= greatest(0.12::DOUBLE, top.match - 0.03::DOUBLE - 1e-6::DOUBLE)", "exact", "item, platform")
    s.add("ambiguous")
    s.put(kinds=_kinds(mine), kind=_m("platform", mine), c=_n("chosen"))
    s.put(anchor="chosen AND platform = kind AND NOT movement AND packaging >= 0")
    s.put(anchors=_n("anchor"), scores="list_reverse_sort(list(match_score) FILTER (anchor) OVER i)", longest=_m("seconds", "anchor AND seconds > 0"))
    s.pick(f"chamber AND c >= 2 AND kinds = 1 AND anchors >= 2 AND platform = kind AND confidence >= 0.45 AND {_OK} AND NOT movement AND packaging >= 0 AND (longest IS NULL OR seconds IS NULL OR seconds <= 0 OR seconds >= greatest(600, floor(longest * 0.75::DOUBLE))) AND match_score >= greatest(0.08::DOUBLE, scores[2] - 0.06::DOUBLE) - 1e-6::DOUBLE", "exact")
    s.add("ambiguous", "added_close")
    s.put(here=_n(mine, "p"))
    s.pick(f"platform IN {_PRIMARY} AND here = 0 AND NOT conflict AND independent", _MODE, "item, platform")
    s.add("ambiguous")
    s.put(tracks=_n("chosen AND track AND platform = 'apple_music'"), videos=_n(f"chosen AND platform IN {_VIDEO}"))
    s.versions(f"tracks > 0 AND videos = 0 AND platform IN {_VIDEO}")
    s.add("true")
    s.put(longest=_m("seconds", f"{held} AND seconds > 0", "p"), most=_m("confidence", held, "p"), best=_m("match_score", held, "p"), c=_n("chosen"))
    s.pick(f"c > 0 AND longest IS NOT NULL AND platform IN {_PRIMARY} AND confidence >= greatest(0.45::DOUBLE, most - 0.05::DOUBLE) AND {_OK} AND NOT movement AND seconds >= floor(longest * 1.35::DOUBLE) AND match_score >= greatest(0::DOUBLE, best - 0.05::DOUBLE - 1e-6::DOUBLE)", "seconds DESC, match_score DESC, confidence", "item, platform")
    s.add("ambiguous", "added_long")
    s.top()
    s.put(kinds=_kinds(f"chosen AND platform IN {_VIDEO}"))
    s.put(pool=f"coalesce(NOT chosen AND chamber_solo AND n BETWEEN 1 AND 2 AND kinds = 1 AND top.platform IN {_VIDEO} AND platform IN {_VIDEO} AND platform <> top.platform AND confidence >= greatest(0.58::DOUBLE, top.sure - 0.16::DOUBLE) AND {_OK} AND title_score >= greatest(0.02::DOUBLE, top.title - 0.08::DOUBLE) - 1e-6::DOUBLE, false)")
    s.put(pool=f"pool AND {_n('pool')} >= 2")
    s.pick("pool", "exact", most=2)
    s.add("ambiguous", "added_low")
    s.put(most=_m("confidence", "chosen"))
    s.versions("most < 0.65")
    s.add("true")
    # limits and order
    s.top()
    s.cross("chosen", _SORT)
    s.put(ties=_n("chosen AND abs(confidence - top.sure) <= 0.01::DOUBLE"), kinds=_kinds(mine), per=f"CASE WHEN {mine} THEN {_n(mine, 'p')} END")
    s.put(lim="""greatest(CASE WHEN n_accepted >= 2 AND hint AND n >= 5 THEN 5 WHEN n_accepted >= 2 THEN least(4, n_accepted) WHEN ambiguous AND sparse THEN 5 WHEN ambiguous THEN 4 WHEN hint AND n >= 5 AND ties >= 3 THEN 5 WHEN crossed THEN 3
      WHEN sparse AND n >= 5 AND kinds >= 2 AND max(per) OVER i >= 2 THEN 5 WHEN NOT dated AND ties > 1 THEN least(4, ties) WHEN ties >= 3 THEN least(4, ties) ELSE 2 END, CASE WHEN close_alternate OR added_close OR added_long OR added_low THEN 3 ELSE 0 END)""", able=f"chosen AND platform IN {_PRIMARY} AND independent")
    s.put(champion=f"able AND row_number() OVER (PARTITION BY item, platform ORDER BY able DESC, {_SORT} DESC, pos) = 1", sure="chosen AND accepted")
    s.put(lim=f"greatest(lim, {_n('champion')})")
    s.put(ahead=f"CASE WHEN n_accepted > 0 AND {_n('sure')} >= greatest(1, lim) THEN sure ELSE false END")
    s.put(place=f"CASE WHEN chosen THEN row_number() OVER (PARTITION BY item ORDER BY chosen DESC, ahead DESC, champion DESC, {_SORT} DESC, pos) END")
    s.put(final="coalesce(place <= lim, false)")
    video = f"final AND platform IN {_VIDEO}"
    s.put(c=_n("final"), per=_n(video, "p"), most=_m("confidence", video, "p"), best=_m("title_score", video, "p"), foremost=f"min(place) FILTER ({video}) OVER p", chosen="final")
    s.put(video_anchor="max({'n': per, 's': most, 'l': -foremost, 'platform': platform, 'best': best}) FILTER (" + video + ") OVER i")
    s.pick("chamber_solo AND c BETWEEN 1 AND 3 AND NOT final AND platform = video_anchor.platform AND confidence >= 0.45 AND confidence < 0.65 AND title_score >= greatest(0.08::DOUBLE, video_anchor.best - 0.02::DOUBLE) - 1e-6::DOUBLE AND zone <> 'red'", "exact")
    s.put(late="pick", chosen="false")
    s.versions("NOT started")
    s.put(stands_in="pick", by_total="row_number() OVER (PARTITION BY item ORDER BY total DESC, pos)")
    s.put(r="row_number() OVER (PARTITION BY item ORDER BY confidence DESC, by_total)", follows="coalesce(lead(confidence) OVER (PARTITION BY item ORDER BY confidence DESC, by_total), 0::DOUBLE)", any_in="bool_or(stands_in) OVER i")
    s.put(rest=f"coalesce({_m('match_score', 'r > 1')}, -0.05::DOUBLE)")
    s.put(how="""CASE WHEN final THEN 'chosen' WHEN late THEN 'late' WHEN NOT started AND stands_in THEN 'version' WHEN NOT started AND NOT any_in AND r = 1 AND (confidence >= 0.58 OR (platform IN ('youtube', 'bilibili', 'apple_music', 'spotify', 'qobuz') AND (
      (confidence >= 0.5 AND (confidence - follows >= 0.08::DOUBLE OR (match_score >= 0.1 AND match_score - rest >= 0.03::DOUBLE - 1e-6::DOUBLE) OR everyone = 1)) OR (confidence >= 0.45 AND match_score >= 0.08 AND (everyone = 1 OR match_score - rest >= 0.05::DOUBLE - 1e-6::DOUBLE))))) THEN 'dominant' END""")
    s.put(place="CASE WHEN final THEN place WHEN late THEN c + 1 WHEN how = 'version' THEN row_number() OVER (PARTITION BY item ORDER BY stands_in DESC, exact DESC, pos) ELSE 1 END")
    return f"WITH {', '.join(s.ctes)} SELECT item, CAST(place AS INTEGER) AS place, url, pos, how FROM s{s.k} WHERE how IS NOT NULL"


def link_candidates(t):
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    made = shared.spread(t("lineitem"), "l_partkey", rows=1_000_000).withColumn("pos", F.row_number().over(order).cast("long")).selectExpr("pos", *(f"{e} AS {n}" for n, e in _CANDIDATES.items()))
    return made.filter(_KEPT)


@query(_sql())
def assembled_links(t):
    """The links that each item keeps of its candidates, by floors, rules that add, limits and stand-ins (ops R13, R14, O10, O11)."""
    return assembly.assembled(link_candidates(t), t("part").selectExpr(*(f"{e} AS {n}" for n, e in _ITEMS.items())))

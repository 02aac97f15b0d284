"""Which floor labels a camera really shows: admission by evidence from outside a label's own run, withdrawal by fix-point elimination.

Reads are brought to a graph for each camera and era by Spark (previous reads come from day-wise carries, counts are pre-aggregated, so a task holds a day of a camera): a label
is a node with its reads, time span, confidence and whether a neighbouring read is reachable at a plausible speed; consecutive reads are an edge where speed and pause are
plausible, or a flip where a label and its one-edit image alternate faster than a lift moves. The graph has at most as many nodes as a camera has labels. It is
judged in one group: components (union-find), those with a labelled floor, and elimination round by round.

Rules: a labelled floor is admitted. A number is, with enough reads and support, unless its component holds no labelled floor (and it isn't alone there, and some labelled
floor was read). Of an admitted label with two or more flips towards the same image, the one with less mean confidence goes, but only while its image is itself admitted, and not in a
round in which its image is up for removal too. What was admitted before comes back if it went for lack of evidence, never if evidence spoke against it."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import carry

US = 1_000_000
KEYS = ["cam", "door_version"]
#: Reasons of reads that count.
CONFIDENT = ("ok", "single_panel")


@dataclass(frozen=True)
class Evidence:
    """Production values: floors a second, seconds between the reads of an edge and of a flip, least floors of a flip, least reads, least flips."""

    speed: float = 3.0
    edge_s: float = 15.0
    flip_s: float = 45.0
    flip_gap: int = 5
    sightings: int = 3
    flips: int = 2

    def scaled(self, by: float) -> Evidence:
        return Evidence(self.speed / by, self.edge_s * by, self.flip_s * by, self.flip_gap, self.sightings, self.flips)


DRIVER = Evidence().scaled(300)


def floor_index(label: Column, order: tuple[str, ...] = ()) -> Column:
    """A label's place: in the declared order, if it stands there, else its number; null for others."""
    text = F.trim(label)
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))
    if not order:
        return number
    place = F.array_position(F.array(*[F.lit(x) for x in order]), text)
    return F.when(place > 0, (place - 1).cast("int")).otherwise(number)


def one_edit_image(a: Column, b: Column) -> Column:
    """Labels of one length that differ in one character, or one that is the other behind a 1."""
    differing = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return F.when(F.length(a) == F.length(b), differing == 1).otherwise((a == F.concat(F.lit("1"), b)) | (b == F.concat(F.lit("1"), a)))


def evidence(door: DataFrame, by: Evidence, order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (KEYS, floor, idx, n, first_us, last_us, conf, supported) and ordered pairs of consecutive labels (KEYS, a, b, edges, flips, flip_at)."""
    reads = door.where(F.col("floor").isNotNull() & F.col("reason").isin(*CONFIDENT)).select(*KEYS, "ts_us", "id", "floor", "read_conf", floor_index(F.col("floor"), order).alias("idx"))
    met = carry.last_before(carry.with_day(reads), KEYS, {"before": F.struct("ts_us", "floor", "idx")})
    dt, gap = (F.col("ts_us") - F.col("before.ts_us")) / US, F.abs(F.col("idx") - F.col("before.idx"))
    plausible = (dt > 0) & (gap / dt <= by.speed)
    met = met.withColumns({"plausible": F.coalesce(plausible, F.lit(False)), "dt": dt, "gap": gap}).drop(carry.DAY)
    flip = ~F.col("plausible") & (F.col("dt") > 0) & (F.col("dt") <= by.flip_s) & (F.col("gap") >= by.flip_gap) & one_edit_image(F.col("before.floor"), F.col("floor"))
    pairs = met.where("before IS NOT NULL AND idx IS NOT NULL AND before.idx IS NOT NULL AND dt > 0").select(
        *KEYS, F.col("before.floor").alias("a"), F.col("floor").alias("b"), "plausible", (F.col("plausible") & (F.col("dt") <= by.edge_s)).cast("int").alias("edge"), flip.cast("int").alias("flip"), F.struct("ts_us", "id").alias("at")
    )
    pairs = pairs.groupBy(*KEYS, "a", "b").agg(
        F.sum("edge").alias("edges"), F.sum(F.col("plausible").cast("int")).alias("near"), F.sum("flip").alias("flips"), F.min(F.when(F.col("flip") == 1, F.col("at"))).alias("flip_at")
    )
    near = pairs.where("near > 0")
    supported = near.select(*KEYS, F.col("a").alias("floor")).unionByName(near.select(*KEYS, F.col("b").alias("floor"))).distinct().withColumn("supported", F.lit(True))
    nodes = reads.groupBy(*KEYS, "floor", "idx").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.avg("read_conf").alias("conf"))
    return nodes.join(supported, [*KEYS, "floor"], "left").withColumn("supported", F.coalesce("supported", F.lit(False))), pairs


def judged(nodes: list[dict], pairs: list[dict], labelled: set[str], prior: set[str], by: Evidence) -> list[dict]:
    """floor, n, first_us, last_us, supported, anchored, flips, twin, admitted, via of each node, and of each prior label that has none."""
    own = {x["floor"]: x for x in nodes}
    numbered = {f for f, x in own.items() if x["idx"] is not None}
    up = {f: f for f in numbered}

    def root(f: str) -> str:
        while up[f] != f:
            up[f] = f = up[up[f]]
        return f

    for p in pairs:
        if p["edges"]:
            up[root(p["a"])] = root(p["b"])
    towards: dict[str, dict[str, list]] = {}
    for p in pairs:
        if p["flips"]:
            for f, image in ((p["a"], p["b"]), (p["b"], p["a"])):
                seen = towards.setdefault(f, {}).setdefault(image, [p["flip_at"], 0])
                seen[0], seen[1] = min(seen[0], p["flip_at"]), seen[1] + p["flips"]
    twins = {}
    for f, images in towards.items():  # the image that a label flipped with first, and how often
        image = min(images, key=lambda i: images[i][0])
        twins[f] = (image, images[image][1])
    anchors = {root(f) for f in labelled & numbered}
    sizes: dict[str, int] = {}
    for f in numbered:
        sizes[root(f)] = sizes.get(root(f), 0) + 1
    out: dict[str, dict] = {}
    for f, x in own.items():
        number = f in numbered
        anchored = not anchors or root(f) in anchors if number else None
        enough, alone = x["n"] >= by.sightings, number and sizes[root(f)] == 1
        if f in labelled:
            via = "labeled"
        elif not number:
            via = "reject:non_numeric_unlabeled"
        elif not x["supported"]:
            via = "reject:no_transition_support"
        elif not enough:
            via = f"reject:only_{x['n']}_sightings"
        else:
            via = "corroborated" if anchored else "corroborated:lone" if alone else "quarantine:unanchored_island"
        out[f] = {**{k: x[k] for k in ("floor", "n", "first_us", "last_us", "supported")}, "anchored": anchored, "flips": twins.get(f, (None, 0))[1], "twin": None, "admitted": via.startswith(("labeled", "corroborated")), "via": via}

    def shadow(f: str) -> bool:
        """Whether flips and confidence speak against f while its image is admitted."""
        image, n = twins.get(f, (None, 0))
        if n < by.flips or f in labelled or not out[image]["admitted"]:
            return False
        a, b = own[f]["conf"], own[image]["conf"]
        return a is not None and b is not None and a < b

    def convict(f: str) -> None:
        out[f] |= {"admitted": False, "twin": twins[f][0], "via": f"quarantine:glyph_shadow_of_{twins[f][0]}"}

    while True:
        pending = {f for f, x in out.items() if x["admitted"] and shadow(f)}
        now = [f for f in pending if twins[f][0] not in pending]
        if not now:
            break
        for f in now:
            convict(f)
    for f in [f for f, x in out.items() if x["via"] == "quarantine:unanchored_island" and shadow(f)]:
        convict(f)
    for f in prior:
        if f not in out:
            out[f] = {"floor": f, "n": 0, "first_us": None, "last_us": None, "supported": False, "anchored": None, "flips": 0, "twin": None, "admitted": True, "via": "retained:no_rows"}
        elif out[f]["via"].startswith(("reject:non_numeric_unlabeled", "reject:only_")):
            out[f] |= {"admitted": True, "via": f"retained:{out[f]['via']}"}
    return list(out.values())


def admission(door: DataFrame, labelled: DataFrame, prior: DataFrame, by: Evidence = Evidence(), order: tuple[str, ...] = ()) -> DataFrame:
    """KEYS, floor, n, first_us, last_us, supported, anchored, flips, twin, admitted, via. labelled, prior: cam, floor; prior labels count for each era of their camera that has reads."""
    nodes, pairs = evidence(door, by, order)
    fields = {"kind": "string", "floor": "string", "idx": "int", "n": "long", "first_us": "long", "last_us": "long", "conf": "double", "supported": "boolean", "a": "string", "b": "string", "edges": "long", "flips": "long", "flip_us": "long", "flip_id": "long"}
    eras = nodes.select(*KEYS).distinct()

    def kind(name: str, df: DataFrame, **own: str) -> DataFrame:
        return df.select(*KEYS, *[(F.lit(name) if k == "kind" else F.col(own[k]) if k in own else F.lit(None)).cast(t).alias(k) for k, t in fields.items()])

    everything = kind("node", nodes, **{k: k for k in ("floor", "idx", "n", "first_us", "last_us", "conf", "supported")})
    everything = everything.unionByName(kind("pair", pairs.where("edges > 0 OR flips > 0"), a="a", b="b", edges="edges", flips="flips", flip_us="flip_at.ts_us", flip_id="flip_at.id"))
    for name, df in (("label", labelled), ("prior", prior)):
        everything = everything.unionByName(kind(name, eras.join(df.select("cam", "floor").distinct(), "cam"), floor="floor"))
    schema = pa.schema(
        [(k, pa.string()) for k in KEYS]
        + [("floor", pa.string()), ("n", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("supported", pa.bool_()), ("anchored", pa.bool_()), ("flips", pa.int64()), ("twin", pa.string()), ("admitted", pa.bool_()), ("via", pa.string())]
    )

    def judge(graph: pa.Table) -> pa.Table:
        rows = graph.to_pylist()
        pick = lambda name: [r for r in rows if r["kind"] == name]
        pair = [r | {"flip_at": (r["flip_us"], r["flip_id"])} for r in pick("pair")]
        found = judged(pick("node"), pair, {r["floor"] for r in pick("label")}, {r["floor"] for r in pick("prior")}, by)
        return pa.Table.from_pylist([{k: rows[0][k] for k in KEYS} | x for x in found], schema)

    return everything.groupBy(*KEYS).applyInArrow(judge, "cam string, door_version string, floor string, n long, first_us long, last_us long, supported boolean, anchored boolean, flips long, twin string, admitted boolean, via string")

"""SVD++ on a bipartite graph: user -> item edges with a rating.

Vertices are spread over blocks by a hash, edges over a grid of cells by the blocks of both ends. Edges go to their cell once, as packed arrays, and
stay there. What moves in a round are arrays of vertices: a block sends each cell the rows of the vertices that have edges there, and gets back
one sum for each of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import quote, unit_hash
from weft.plans.iterate import Rounds

USER, ITEM = 0, 1
SIDE, FEW = 6, 50_000  # rows and columns of the grid, less where cells had fewer edges
MANY, MOST = 8_000_000, 12_000_000  # edges of a cell: more rows and columns above; an uneven cell is divided
BLOCK_BYTES = 16 << 20  # of a block's state
CHUNK = 500_000  # edges worked on at once
MESSAGES = "s long, vb int, role int, x binary"
STATE = "vb int, norm binary, oku binary, oki binary, f binary, y binary, b binary"
ROUTES = "tos array<long>, roles array<int>, at array<binary>"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def batch(schema: str, rows: list, ids=None):
    """Rows of numbers and numpy arrays as an Arrow table."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    raw = lambda x: x.tobytes() if isinstance(x, np.ndarray) else x
    return pa.table([pa.array([raw(r[k]) for r in rows], kinds[c.split()[1]]) for k, c in enumerate(schema.split(", "))] + ([] if ids is None else [ids]), names(schema) + ["ids"] * (ids is not None))


def floats(x: bytes, width: int = 0) -> np.ndarray:
    found = np.frombuffer(x)
    return found.reshape(-1, width) if width else found


def listed(ids: list):
    """Arrays of ids as one array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.concat_arrays(ids))


def sums(at: np.ndarray, n: int, *values: np.ndarray) -> np.ndarray:
    """A column for each of the values, added up by `at`."""
    return np.stack([np.bincount(at, v, n) for v in values], 1)


CELLS = "s long, vb int, role int, a binary, b binary, c binary, d binary, users binary, items binary"


def as_cell(s: int, u, ub: np.ndarray, i, ib: np.ndarray, w: np.ndarray):
    """A row of edges, which tell their ends by place, and one for each block with ends in the cell: the ids, in the order of places, and per id
    its edges, those with a rating, their sum, and those that count: with a rating and both ends."""
    rated = ~np.isnan(w)
    counts = rated & np.asarray(u.is_valid()) & np.asarray(i.is_valid())
    rows, ids, places, ends = [], [], [], []
    for role, x, vb in ((USER, u, ub), (ITEM, i, ib)):
        code = x.dictionary_encode("encode")
        at, n = np.asarray(code.indices), len(code.dictionary)
        block = np.empty(n, np.int32)
        block[at] = vb
        order = np.argsort(block, kind="stable")
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        at = place[at]
        found, each = np.unique(block, return_counts=True)
        all_, some, ok = (np.bincount(at, t, n).astype(np.int32) for t in (None, rated, counts))
        total, known, low = np.bincount(at, np.where(rated, w, 0), n), code.dictionary.take(pa.array(order)), 0
        for b, k in zip(found, each):
            rows.append((s, int(b), role, all_[low : low + k], some[low : low + k], total[low : low + k], ok[low : low + k], None, None))
            ids.append(known[low : low + k])
            low += k
        places.append(at)
        ends.append(np.stack([found, each], 1).astype(np.int32))
    w = np.where(counts, w, np.nan)
    order = np.argsort(places[0], kind="stable")
    levels, code = np.unique(w, return_inverse=True)
    packed = code.astype(np.uint8) if len(levels) <= 256 else w
    rows.append((s, -1, -1, places[0][order], places[1][order], packed[order], levels if len(levels) <= 256 else b"", *ends))
    return batch(CELLS, rows, listed([*ids, known[:0]]))


def to_cells(e: DataFrame, side: int, blocks: int) -> DataFrame:
    """What as_cell makes of the edges (u, i, w) of each cell; of one beyond MOST edges in several rows, which are cells of their own."""
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    most = MOST

    def run(batches):
        held, parts = {}, {}

        def cell(c):
            t = pa.concat_tables(held.pop(c)).combine_chunks()
            one = lambda k: t.column(k).chunk(0)
            parts[c] = parts.get(c, -1) + 1
            return as_cell(c + side * side * parts[c], one("u"), one("ub").to_numpy(), one("i"), one("ib").to_numpy(), one("w").to_numpy(False)).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            cells = t.column("cell").to_numpy()
            for c in (found := np.unique(cells).tolist()):
                held.setdefault(c, []).append(t.filter(pa.array(cells == c)) if len(found) > 1 else t)
                if sum(map(len, held[c])) >= most:
                    yield from cell(c)
        for c in list(held):
            yield from cell(c)

    sent = e.select("u", "i", "w", of("u").alias("ub"), of("i").alias("ib")).withColumn("cell", F.col("ub") % side * side + F.col("ib") % side)
    return sent.repartitionById(side * side, "cell").mapInArrow(run, f"{CELLS}, ids array<{e.schema['u'].dataType.simpleString()}>")


HOME = f"vb int, n binary, nw binary, sw binary, oku binary, oki binary, {ROUTES}"


def to_blocks(t):
    """A block's row: its ids and what their cells know of them, and for each cell and role the places of the ids that it has, in its order."""
    t = t.sort_by([("s", "ascending"), ("role", "ascending")])
    code = pa.concat_arrays([x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for x in t.column("ids").chunks]).dictionary_encode("encode")
    at, n = np.asarray(code.indices).astype(np.int32), len(code.dictionary)
    ints = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.int32)
    cuts = np.cumsum([len(x) // 4 for x in t.column("a").to_pylist()])[:-1]
    role = np.concatenate([np.full(len(x) // 4, r) for x, r in zip(t.column("a").to_pylist(), t.column("role").to_pylist())])
    total = lambda v: np.bincount(at, v, n)
    row = (t.column("vb")[0].as_py(), total(ints("a")), total(ints("b")), total(floats(b"".join(t.column("c").to_pylist()))), total(ints("d") * (role == USER)), total(ints("d") * (role == ITEM)))
    return batch(HOME, [(*row, t.column("s").to_pylist(), t.column("role").to_pylist(), [x.tobytes() for x in np.split(at, cuts)])], listed([code.dictionary]))


def routes(row: dict):
    """(cell, role, places) of a block's row."""
    return [(s, r, np.frombuffer(x, np.int32)) for s, r, x in zip(row["tos"], row["roles"], row["at"])]


def gathered(row: dict, t, role: int, width: int) -> np.ndarray:
    """The sums that a block's vertices have in `role`, over all cells."""
    total = np.zeros((len(floats(row["b"])), width))
    place = {s: at for s, r, at in routes(row) if r == role}
    mine = [x for x in t.to_pylist() if x["role"] == role]
    for x in sorted(mine, key=lambda x: x["s"]):
        total[place[x["s"]]] += floats(x["x"], width)
    return total


class Cell:
    """A cell's edges, and the rows that its vertices were sent."""

    def __init__(self, t, sent):
        self.row, self.sent = t.to_pylist()[0], sent.select(["vb", "role", "x"]).to_pylist()
        self.ends = [np.frombuffer(self.row[k], np.int32).reshape(-1, 2) for k in ("users", "items")]
        self.n = [int(x[:, 1].sum()) for x in self.ends]
        self.u, self.i = (np.frombuffer(self.row[k], np.int32) for k in "ab")

    def values(self, role: int, width: int) -> np.ndarray:
        return floats(b"".join(x["x"] for x in sorted(self.sent, key=lambda x: x["vb"]) if x["role"] == role), width)

    def chunks(self):
        """(users, items, ratings), some at a time; a rating that doesn't count is nan."""
        levels = floats(self.row["d"])
        w = levels[np.frombuffer(self.row["c"], np.uint8)] if len(levels) else floats(self.row["c"])
        for k in range(0, len(w), CHUNK):
            yield self.u[k : k + CHUNK], self.i[k : k + CHUNK], w[k : k + CHUNK]

    def back(self, *sums_of: tuple[int, np.ndarray]):
        rows = []
        for role, x in sums_of:
            parts = np.split(x, np.cumsum(self.ends[role][:, 1])[:-1])
            rows += [(self.row["s"], int(vb), role, part) for (vb, _), part in zip(self.ends[role], parts)]
        return batch(MESSAGES, rows)


def svd_plus_plus(g, rank: int = 10, max_iter: int = 2, min_value: float = 0.0, max_value: float = 5.0, gamma1: float = 0.007, gamma2: float = 0.007, gamma6: float = 0.005, gamma7: float = 0.015, seed: int = 42, weight_col: str = "weight") -> tuple[DataFrame, float]:
    """(vertices with column1 to column4, mean squared training error).

    column1: factors (of users p, of items q); column2: implicit factors (of items y; of users p + |N|^-1/2 sum of y); column3: bias
    (at first: against the mean rating); column4: of users |N|^-1/2, of items the sum of squared errors. Rounds are full-batch gradient steps;
    initial factors are hashes of (id, slot, seed), so runs repeat. Edges without a rating count for |N| and the sum of y only.
    """
    spark = g.vertices.sparkSession
    rounds = Rounds(spark, "svdpp")
    e = rounds.cut(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("i"), F.col(quote(weight_col)).cast("double").alias("w")))
    mean, n_edges, n_users, n_items = e.agg(F.avg("w"), F.count("*"), F.approx_count_distinct("u"), F.approx_count_distinct("i")).first()
    if mean is None:
        raise ValueError("svd_plus_plus needs edges")
    side = max(min(SIDE, math.ceil(math.sqrt(n_edges / FEW))), math.ceil(math.sqrt(n_edges / MANY)))
    blocks = side * math.ceil((n_users + n_items + 1) * (2 * rank + 4) * 8 / side / BLOCK_BYTES)
    by = lambda df, key: rounds.cache(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))
    made = rounds.write(to_cells(e, side, blocks), "-cells")
    kind = made.schema["ids"].dataType.simpleString()
    cells = by(made.where("vb < 0").select("s", "a", "b", "c", "d", "users", "items"), "s")
    home = rounds.write(made.where("vb >= 0").select("vb", "s", "role", "a", "b", "c", "d", "ids").groupBy("vb").applyInArrow(to_blocks, f"{HOME}, ids {kind}"), "-home")

    def begin(batches):
        for t in batches:
            for k in range(len(t)):
                x = {c: t.column(c)[k] for c in t.schema.names}
                n, nw, sw = (floats(x[c].as_py()) for c in ("n", "nw", "sw"))
                f, y = (np.stack([x[f"{c}{j}"].values.to_numpy(False) for j in range(rank)], 1) for c in "fy")
                with np.errstate(invalid="ignore"):
                    b = sw / nw - mean
                y = np.where(np.asarray(x["ids"].values.is_valid())[:, None], y, 0.0)  # what has no id gives nothing
                yield from batch(STATE, [(x["vb"].as_py(), 1 / np.sqrt(n), x["oku"].as_py(), x["oki"].as_py(), f, y, b)]).to_batches()

    slot = lambda tag, k: F.transform("ids", lambda x: unit_hash(x, tag, k, seed))
    slots = [slot(tag, k).alias(f"{name}{k}") for name, tag in (("f", "p"), ("y", "y")) for k in range(rank)]
    state = rounds.cut(home.select("vb", "n", "nw", "sw", "oku", "oki", "ids", *slots).mapInArrow(begin, STATE))
    ways = by(home.select("vb", *names(ROUTES)), "vb")

    def exchange(state: DataFrame, send, work, take, schema: str) -> DataFrame:
        """Blocks send rows to cells, cells send sums back, blocks take them."""

        def scatter(batches):
            for t in batches:
                for row in t.to_pylist():
                    values = send(row)
                    for s, role, at in routes(row):
                        if values[role] is not None:
                            yield from batch(MESSAGES, [(s, row["vb"], role, values[role][at])]).to_batches()

        sent = state.mapInArrow(scatter, MESSAGES)
        back = cells.groupBy("s").cogroup(sent.groupBy("s")).applyInArrow(lambda t, sent: work(Cell(t, sent)), MESSAGES)
        return state.groupBy("vb").cogroup(back.groupBy("vb")).applyInArrow(lambda t, back: take(t.to_pylist()[0], back), schema)

    def implicit(cell):
        y, found = cell.values(ITEM, rank), np.zeros((cell.n[USER], rank))
        for u, i, _ in cell.chunks():
            found += sums(u, cell.n[USER], *(y[i, k] for k in range(rank)))
        return cell.back((USER, found))

    def with_items(row, back):
        user = np.isin(np.arange(len(floats(row["b"]))), np.concatenate([at for _, r, at in routes(row) if r == USER] or [[]]))
        z = floats(row["f"], rank) + floats(row["norm"])[:, None] * gathered(row, back, USER, rank)
        return batch("vb int, user binary, z binary", [(row["vb"], user, np.where(user[:, None], z, 0.0))])

    def factors(row):
        b = floats(row["b"])[:, None]
        return np.hstack([floats(row["z"], rank), b, floats(row["norm"])[:, None]]), np.hstack([floats(row["f"], rank), b])

    def errors(cell):
        """(users, items, user's row, item's row, error): 0 where a rating doesn't count."""
        users, items = cell.values(USER, rank + 2), cell.values(ITEM, rank + 1)
        for u, i, w in cell.chunks():
            p, q = users[u], items[i]
            guess = mean + p[:, rank] + q[:, rank] + np.einsum("ij,ij->i", p[:, :rank], q[:, :rank])
            err = w - np.minimum(max_value, np.maximum(min_value, guess))
            yield u, i, p, q, np.where(np.isnan(err), 0.0, err)

    def gradients(cell):
        user, item = np.zeros((cell.n[USER], rank + 1)), np.zeros((cell.n[ITEM], rank + 2))
        for u, i, p, q, err in errors(cell):
            user += sums(u, cell.n[USER], *(err * q[:, k] for k in range(rank)), err)
            item += sums(i, cell.n[ITEM], *(err * p[:, k] for k in range(rank)), err * p[:, rank + 1], err)
        return cell.back((USER, user), (ITEM, item))

    def moved(row, back):
        user, item = gathered(row, back, USER, rank + 1), gathered(row, back, ITEM, rank + 2)
        f, y, b, of_user, of_item = floats(row["f"], rank), floats(row["y"], rank), floats(row["b"]), floats(row["oku"]), floats(row["oki"])
        new_f = f + gamma2 * (user[:, :rank] + item[:, :rank] - gamma7 * (of_user + of_item)[:, None] * f)
        new_y = y + gamma2 * (item[:, rank : rank + 1] * f - gamma7 * of_item[:, None] * y)
        new_b = b + gamma1 * (user[:, rank] + item[:, rank + 1] - gamma6 * (of_user + of_item) * b)
        return batch(STATE, [(row["vb"], row["norm"], row["oku"], row["oki"], new_f, new_y, new_b)])

    def squares(cell):
        found = np.zeros((cell.n[ITEM], 1))
        for _, i, _, _, err in errors(cell):
            found += sums(i, cell.n[ITEM], err * err)
        return cell.back((ITEM, found))

    def finish(row, back):
        sq, y, of_item, user = gathered(row, back, ITEM, 1)[:, 0], floats(row["y"], rank), floats(row["oki"]), np.frombuffer(row["user"], bool)
        implicit = np.where(user[:, None], floats(row["z"], rank), y)
        return batch("vb int, f binary, v binary, b binary, last binary, sq binary, n binary", [(row["vb"], row["f"], implicit, row["b"], np.where(of_item > 0, sq, floats(row["norm"])), np.array([sq.sum()]), np.array([of_item.sum()]))])

    def unpacked(batches):
        for t in batches:
            for k in range(len(t)):
                x = {c: t.column(c)[k] for c in t.schema.names}
                ids, n = x["ids"].values, len(x["ids"].values)
                vectors = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rank), pa.array(floats(x[c].as_py()))) for c in "fv"]
                b = floats(x["b"].as_py())
                done = pa.table([ids, *vectors, pa.array(b, mask=np.isnan(b)), pa.array(floats(x["last"].as_py()))], ["id", "column1", "column2", "column3", "column4"])
                yield from done.filter(ids.is_valid()).to_batches(100_000)

    def at_home(state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The state with its routes, and the same with the users' z."""
        own = by(state, "vb")
        here = own.join(ways, "vb")
        z = rounds.cut(exchange(here, lambda row: (None, floats(row["y"], rank)), implicit, with_items, "vb int, user binary, z binary"))
        return own, here.join(z, "vb")

    for _ in range(max_iter):
        own, here = at_home(state)
        state = rounds.cut(exchange(here, factors, gradients, moved, STATE))
        own.unpersist()
    last = rounds.write(exchange(at_home(state)[1], factors, squares, finish, "vb int, f binary, v binary, b binary, last binary, sq binary, n binary"), "-last")
    totals = [(np.frombuffer(r.sq)[0], np.frombuffer(r.n)[0]) for r in last.select("sq", "n").collect()]
    loss = math.fsum(x for x, _ in totals) / sum(n for _, n in totals)
    done = last.join(home.select("vb", "ids"), "vb").mapInArrow(unpacked, f"id {kind[6:-1]}, column1 array<double>, column2 array<double>, column3 double, column4 double")
    done = rounds.close(done)
    kept = [c for c in g.vertices.columns if c not in done.columns or c == "id"]
    if kept == ["id"] and g._ends_known:
        return done, loss
    return g.vertices.select(*[F.col(quote(c)) for c in kept]).join(done, "id"), loss

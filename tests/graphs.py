"""Small literal graphs."""

from graphloom.functions import states as S
from graphloom.sources.frames import SCHEMAS, Frames


class Builder:
    """Collects rows; names are labels, ids are given in order."""

    def __init__(self):
        self.rows = {name: [] for name in SCHEMAS}
        self.ids = {"": 1}
        self.rows["node"].append((1, "root", "", 1, False))

    def _node(self, kind, label, creator="", detached=False):
        self.ids[label] = i = len(self.ids) + 1
        self.rows["node"].append((i, kind, label, None if creator is None else self.ids[creator], detached))
        return i

    def file(self, label, state=S.CONFIRMED, creator="", detached=False):
        self.rows["file"].append((self._node("file", label, creator, detached), state, "d" if state in (S.CONFIRMED, S.BUILT, S.OUTDATED) else None))

    def step(self, label, state=S.PENDING, creator="", inp=(), out=(), need=S.DEFAULT, duration=1, deferred=False, holding=0, has_hash=False, dynamic=(), detached=False, resources=()):
        i = self._node("step", label, creator, detached)
        self.rows["step"].append((i, state, need, duration, deferred, 0, holding, has_hash))
        for f in (*inp, *dynamic):
            self.edge(f, label, f in dynamic)
        for f in out:
            self.edge(label, f)
        self.rows["step_resource"] += [(i, n, u) for n, u in resources]

    def edge(self, a, b, dynamic=False):
        d = self.rows["dependency"]
        d.append((len(d) + 1, self.ids[a], self.ids[b], dynamic))

    def frames(self, spark):
        return Frames(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in self.rows.items()})

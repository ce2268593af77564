"""The stream's open fixes in the state: what stands there, and how often it is called."""

from wayfold.streaming.online_stream import BLOCK, _Fixes


class Store(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def fix(k):
    return float(k), -float(k), 5.0 * k


def test_fixes_stand_in_blocks():
    store, base, end = Store(), 0, 0
    for batch, (new, closed) in enumerate([(10, 0), (0, 0), (200, 30), (1, 0), (500, 600), (60, 0), (0, 30), (90, 201)]):
        before, fixes = store.calls, _Fixes(store, base, end)
        for k in range(end, end + new):
            fixes.road = f"r{k}"
            fixes.append(fix(k))
        if closed:
            del fixes[:closed]
        fixes.commit()
        base, end = fixes.base, fixes.end
        # no call for each fix: one for a block, and a read for the block that was begun before
        assert store.calls - before <= new // BLOCK + closed // BLOCK + 5, batch
        read = _Fixes(store, base, end)
        assert len(read) == end - base and [read[k] for k in range(len(read))] == [(*fix(k), f"r{k}") for k in range(base, end)]
    assert (base, end) == (861, 861) and not store

"""The line commands over a store: fill, get, scan, put, delete, test, flush, compact, dump, json, close."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

from palimpsest.sources.store import Store


def run(store: Store, lines: Iterable[str]) -> Iterator[str]:
    """What each line answers. The epoch counts lines, but not those with malformed arguments."""
    epoch = 0
    shown = lambda r: f"{int.from_bytes(r['k'], 'big') if len(r['k']) == 8 else bytes(r['k'])}={bytes(r['v']).decode()}"
    for line in lines:
        parts, began = line.strip().split(" ", 2), time.monotonic()
        cmd = parts[0]
        try:
            if cmd in ("fill", "scan", "test"):
                a, b = map(int, parts[1:])
            elif cmd in ("get", "delete"):
                (a,) = map(int, parts[1:])
            elif cmd == "put":
                a, value = int(parts[1]), parts[2]
        except (ValueError, IndexError):
            yield f"malformed: {line.strip()}"
            continue
        took = lambda: f"{time.monotonic() - began:.3f} s"  # noqa: B023, E731
        if cmd == "fill":
            store.fill(a, b, epoch)
            yield f"{b - a + 1} values filled in {took()}"
        elif cmd == "get":
            got = store.get(a)
            yield f"{a}={got.decode()}" if got is not None else f"{a} not exist"
        elif cmd == "scan":
            n = 0
            for row in store.scan(a, b).toLocalIterator():
                n += 1
                yield shown(row)
            yield f"{n} keys scanned in {took()}"
        elif cmd == "test":
            yield f"{store.count(a, b)} keys scanned in {took()}"
        elif cmd == "put":
            store.put(a, value)
            yield f"{a}={value} written in {took()}"
        elif cmd == "delete":
            store.delete(a)
            yield f"{a} deleted"
        elif cmd == "flush":
            store.flush()
            yield "flushed"
        elif cmd == "compact":
            store.compact_all()
            yield "compacted"
        elif cmd == "dump":
            yield from (f"memory {t['id']} {t['size']} bytes" for t in store.state["tables"])
            yield from (f"L{f['level']} {f['sst_id']} [{f['first_key']}, {f['last_key']}] {f['n']} rows" for f in store.files())
        elif cmd == "json":
            yield store.json()
        elif cmd in ("quit", "close"):
            store.close()
            return
        else:
            yield f"unknown command: {cmd}"
        epoch += 1

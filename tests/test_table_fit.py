"""Table fitting against a plain search, point by point and cell by cell."""

import random

from reportloom.operators import table_fit as TF

PT = 12_700


def lines_of(text):
    return [x.strip() for x in (text or "").split("\n") if x.strip()] or [""]


def wraps(text, letter, room):
    """Lines of narrow letters: words move down whole, longer ones are cut."""
    if room <= 0:
        return 1
    n, used, word = 1, 0.0, 0.0
    for c in text:
        half = letter * 0.5
        if c == " ":
            n, used, word = (n + 1, 0.0, 0.0) if used + word + half > room else (n, used + word + half, 0.0)
        elif used + word + half > room:
            n += used > 0
            if word + half > room:
                n, used, word = n + int((word + half) // room), 0.0, (word + half) % room
            else:
                used, word = 0.0, word + half
        else:
            word += half
    return max(1, n)


def level(total_at, target, high):
    low = 0.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if total_at(mid) < target else (low, mid)
    return high


def plain_widths(mins, maxs, usable):
    if usable <= 0 or sum(mins) > usable:
        return None
    if sum(maxs) <= usable:
        v = level(lambda x: sum(max(w, x) for w in maxs), usable, usable)
        return [max(w, v) for w in maxs]
    v = level(lambda x: sum(max(a, min(b, x)) for a, b in zip(mins, maxs, strict=True)), usable, max(maxs))
    return [max(a, min(b, v)) for a, b in zip(mins, maxs, strict=True)]


def plain_fit(table, rules, room):
    """(point, widths, cells) of a table: rows of (header?, text) without spans."""
    columns = len(table[0])
    body = [[c for c in row if not c[0]] for row in table]
    has_body = any(body)
    notes = {k for k in range(columns) for row in table if row[k][0] and "".join(lines_of(row[k][1])).replace(" ", "") in rules.note_columns}
    mins, maxs = [0.0] * columns, [0.0] * columns
    for row in table:
        for k, (head, text) in enumerate(row):
            word = max((len(w) for x in lines_of(text) for w in x.split()), default=0) * 0.5
            wide = word if head and has_body else max(len(x) for x in lines_of(text)) * 0.5
            mins[k], maxs[k] = max(mins[k], word), max(maxs[k], wide, word)

    def at(page, size, scale, margin):
        usable = int(int(room * rules.pages[page]) * (1 - rules.safety)) - 2 * margin * columns - rules.border * (columns + 1)
        lo, hi = [w * size * scale for w in mins], [w * size * scale for w in maxs]
        found = plain_widths(lo, hi, usable)
        if found and rules.equal_columns:
            note_size, cap = min(rules.note_size or size, size), rules.note_share * usable
            note_scale = next((c for c in rules.note_scales if sum(maxs[k] for k in notes) * note_size * c <= cap), (rules.note_scales or (1.0,))[-1])
            natural = {k: maxs[k] * note_size * note_scale for k in notes}
            factor = min(1.0, cap / sum(natural.values())) if sum(natural.values()) else 1.0
            data = [k for k in range(columns) if k not in notes]
            if data and (len(data) > 1 or notes):
                equal = (usable - sum(natural.values()) * factor) / len(data)
                if equal + 1e-6 >= max(hi[k] for k in data) and all(natural[k] * factor + 1e-6 >= mins[k] * note_size * note_scale for k in notes):
                    found = [natural[k] * factor if k in notes else equal for k in range(columns)]
        return found

    points = rules.points()
    good = None
    for i, p in enumerate(points):
        w = at(*p)
        if w and all(wraps(x, p[1] * p[2], w[k]) <= rules.most_lines for row in table for k, (head, text) in enumerate(row) if not (head and has_body) and k not in (notes if rules.equal_columns else ()) for x in lines_of(text)):
            good = i, w
            break
    if good is None:
        per_page = len(points) // len(rules.pages)
        good = next(((i, at(*points[i])) for i in range(per_page - 1, len(points), per_page) if at(*points[i])), (None, None))
    page, size, scale, margin = points[-1 if good[0] is None else good[0]]
    widths = good[1]
    if widths is None:
        usable = max(int(int(room * rules.pages[-1]) * (1 - rules.safety)) - 2 * margin * columns - rules.border * (columns + 1), columns)
        widths = [w * usable / sum(mins) for w in mins] if sum(mins) else [usable / columns] * columns
    whole = [round(w) + 2 * margin for w in widths]
    cells = {}
    if rules.most_lines:
        for r, row in enumerate(table):
            for k, (head, text) in enumerate(row):
                if head or (rules.equal_columns and k in notes):
                    continue
                count = lambda s, text=text, k=k: sum(wraps(x, s[0] * s[1], whole[k] - 2 * margin) for x in lines_of(text))
                smaller = [s for s in rules.steps() if s[0] * s[1] < size * scale]
                if count((size, scale)) > rules.most_lines and smaller:
                    cells[r, k] = next((s for s in smaller if count(s) <= rules.most_lines), smaller[-1])
        for k in range(columns):
            own = [cells[r, k] for r in range(len(table)) if (r, k) in cells]
            for r, row in enumerate(table):
                if own and not row[k][0]:
                    cells[r, k] = min(own, key=lambda s: s[0] * s[1])
    if rules.equal_columns and notes:
        natural, inside = sum(maxs[k] for k in notes), sum(whole) - 2 * margin * columns
        note_size = min(rules.note_size or size, size)
        note_scale = next((c for c in rules.note_scales if natural * note_size * c <= rules.note_share * inside), (rules.note_scales or (1.0,))[-1])
        if note_size * note_scale < size * scale:
            cells |= {(r, k): (note_size, note_scale) for r in range(len(table)) for k in notes}
    table_size = size
    if rules.spread and cells and size - min(s for s, _ in cells.values()) > rules.spread:
        fitting = [s for s in rules.sizes if s <= min(c for c, _ in cells.values()) + rules.spread]
        table_size = min(size, max(fitting) if fitting else min(rules.sizes))
    cells = {k: s for k, s in cells.items() if s[0] * s[1] < table_size * scale}
    if page == 0 and good[0] is not None and 0 < sum(whole) < room:
        wide = [w * room // sum(whole) for w in whole]
        wide[-1] += room - sum(wide)
        whole = wide
    return good[0], table_size, whole, cells


def test_fit_against_a_plain_search(spark):
    rng = random.Random(11)
    tables = {}
    for t in range(40):
        columns, heads = rng.randrange(1, 5), rng.randrange(0, 2)
        word = lambda: "abcdefghijkl"[: rng.randrange(1, 12)]
        text = lambda: "\n".join(" ".join(word() for _ in range(rng.randrange(0, 7))) for _ in range(rng.choice([1, 1, 1, 4])))
        rows = [[(r < heads, rng.choice(["note", "other head"]) if r < heads else text()) for _ in range(columns)] for r in range(rng.randrange(1, 5))]
        tables[t] = rows, rng.randrange(200_000, 2_500_000)
    cells = [(t, r, k, k, 1, head, text or None, None, room) for t, (rows, room) in tables.items() for r, row in enumerate(rows) for k, (head, text) in enumerate(row)]
    df = spark.createDataFrame(cells, "table_id long, row_idx long, cell_idx long, grid_col long, colspan int, is_header boolean, text string, align string, available long").cache()
    base = dict(sizes=(12 * PT, 10 * PT, 8 * PT), scales=(1.0, 0.9), margins=(30_000, 10_000), border=1_000, safety=0.02, most_lines=2)
    for rules in (TF.Rules(**base, pages=(1.0, 1.5)), TF.Rules(**base, spread=PT, equal_columns=True, note_columns=("note",), note_size=9 * PT, note_scales=(1.0, 0.8))):
        layouts, looks = TF.fit_tables(df, rules)
        fitted = {r["table_id"]: r for r in layouts.collect()}
        small = {(r["table_id"], r["row_idx"], r["cell_idx"]): (r["cell_size"], r["cell_scale"]) for r in looks.collect() if r["cell_size"]}
        seen = set()
        for t, (rows, room) in tables.items():
            point, size, widths, own = plain_fit(rows, rules, room)
            r = fitted[t]
            assert (r["point"], r["size"], r["overflow"]) == (point, size, point is None), (t, rows, room)
            assert all(abs(a - b) <= 2 for a, b in zip(r["widths"], widths, strict=True)), (t, r["widths"], widths)
            if not rules.equal_columns or point is not None:
                assert {k: s for (i, *k), s in small.items() if i == t for k in [tuple(k)]} == own, (t, rows)
            seen.add(point)
        assert len(fitted) == len(tables) and len(seen) > 3 and (rules.equal_columns or None in seen)


def test_spans_alignment_and_even_cells(spark):
    rules = TF.Rules(sizes=(12 * PT, 9 * PT), scales=(1.0, 0.9), most_lines=3, uniform=True, list_marks=("-",), header_lines=1)
    rows = [("구분", "배송 수량(단위: 개)", True), ("가", "- 하나", False), ("나", "1\n2\n3\n4", False)]
    cells = [(1, r, k, k, 1, head, text, None, 1_600_000) for r, (*texts, head) in enumerate(rows) for k, text in enumerate(texts)]
    cells += [(1, 3, 0, 0, 2, False, "둘에 걸친 칸", "center", 1_600_000)]
    df = spark.createDataFrame(cells, "table_id long, row_idx long, cell_idx long, grid_col long, colspan int, is_header boolean, text string, align string, available long")
    layouts, looks = TF.fit_tables(df, rules)
    r = layouts.first()
    assert sum(r["widths"]) == 1_600_000 and not r["overflow"]
    got = {(x["row_idx"], x["cell_idx"]): x for x in looks.collect()}
    assert [got[k]["cell_align"] for k in ((0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (3, 0))] == [None, None, "left", "left", "left", None]
    assert {got[k]["cell_scale"] for k in ((1, 0), (1, 1), (2, 0), (2, 1))} != {None}
    assert TF.fit_tables(df.limit(0), rules)[0].count() == 0

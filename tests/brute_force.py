"""X1..X87 from their definitions, one shopper and one feature at a time."""

from __future__ import annotations

LIMITS = (30, 60, 90, 120, 150, 180, 1000)
ID, DEPT, CATEGORY, COMPANY, BRAND, DATE, QUANTITY, AMOUNT = 0, 2, 3, 4, 5, 6, 9, 10


def total(values) -> float:
    return float(sum(values))


def matrix(log, offers, history, before_offer=False) -> dict[int, dict[str, float]]:
    by_number = {o[0]: o for o in offers}
    offered_categories = {o[1] for o in offers}
    offered_companies = {o[3] for o in offers}
    distinct_rows = set(log)
    users = {r[ID] for r in log}
    latest = {}
    for r in log:
        latest[r[CATEGORY]] = max(latest.get(r[CATEGORY], (r[DATE], r[DEPT])), (r[DATE], r[DEPT]))

    result = {}
    for shopper, _, number, _, _, _, offer_day in history:
        if number not in by_number:
            continue
        _, category, _, company, value, brand = by_number[number]

        def ago(r):
            return (offer_day - r[DATE]).days  # noqa: B023

        mine = [r for r in log if r[ID] == shopper and (not before_offer or ago(r) > 0)]
        if not mine:
            continue
        same = {
            "category": [r for r in mine if r[CATEGORY] == category],
            "company": [r for r in mine if r[COMPANY] == company],
            "brand": [r for r in mine if r[BRAND] == brand],
        }
        own = [r for r in same["category"] if r[COMPANY] == company and r[BRAND] == brand]
        dept = [r for r in mine if r[DEPT] == latest[category][1]]

        x = {f"X{i + 1}": int(bool(rows)) for i, rows in enumerate(same.values())}
        x["X4"], x["X5"], x["X6"] = (
            x["X1"] * x["X2"] * x["X3"], x["X2"] * x["X3"], x["X1"] * x["X3"],
        )
        x["X7"], x["X8"] = total(r[AMOUNT] for r in mine), float(value)
        place = 0
        for rows in same.values():
            for limit in LIMITS:
                inside = [r for r in rows if ago(r) <= limit]
                x[f"X{9 + place}"] = len(inside)
                x[f"X{30 + place}"] = total(r[AMOUNT] for r in inside)
                x[f"X{51 + place}"] = sum(r[QUANTITY] for r in inside)
                place += 1
        universe = {
            r for r in mine if r[CATEGORY] in offered_categories or r[COMPANY] in offered_companies
        }
        x["X72"] = total(r[AMOUNT] for r in universe)
        x["X73"] = total(r[AMOUNT] for r in mine if ago(r) <= 29)
        x["X74"] = total(r[AMOUNT] for r in own if ago(r) <= 29)
        x["X75"] = sum(r[QUANTITY] for r in own if ago(r) <= 29)
        x["X76"], x["X77"] = total(r[AMOUNT] for r in own), sum(r[QUANTITY] for r in own)
        x["X78"] = total(r[AMOUNT] for r in dept if ago(r) <= 29)
        x["X79"] = sum(r[QUANTITY] for r in dept if ago(r) <= 29)
        x["X80"] = len({r[DATE] for r in mine if ago(r) <= 29})
        x["X81"], x["X82"] = max(map(ago, mine)), min(map(ago, mine))
        x["X83"] = int(any(r[AMOUNT] < 0 for r in own))

        wanted = (category, company, brand)
        product = [r for r in log if (r[CATEGORY], r[COMPANY], r[BRAND]) == wanted]
        if not product:
            continue
        in_category = [r for r in distinct_rows if r[CATEGORY] == category]
        x["X84"] = len(product) / len(in_category)
        x["X85"] = x["X76"] if x["X76"] >= x["X84"] else -100 * x["X84"]
        x["X86"] = len({r[ID] for r in product}) / len(users)
        x["X87"] = len({r[ID] for r in in_category}) / len(users)
        result[shopper] = x
    return result

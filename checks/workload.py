"""Fifty metrics and 28 ratios, the size of a real reporting set."""

from __future__ import annotations

from checks.star import agg, cond, field, op, value

_MEASURES = ("soldeconvertie", "soldeorigine", "cumulmvtdb", "cumulmvtcr", "amount")
_FILTERS = (
    None,
    cond("grpaffaire", "=", "BUILDING"),
    cond("contratActif", "=", 1),
    cond("typcontrat", "IN", ["1-URGENT", "2-HIGH"]),
    cond("chapitre", "BETWEEN", [1000, 2500]),
    cond("geo", "=", "ASIA"),
    cond("douteux", "=", 1),
    [cond("devise", "STARTS_WITH", "NATION_1"), cond("amount", ">", 10)],
    {"logic": "OR", "conditions": [cond("raisonsoc", "CONTAINS", "ING"), cond("tauxcontrat", "<", 4)]},
)
METRICS50 = {
    f"{m.upper()}_{i}": agg("SUM", m, f) for i, f in enumerate(_FILTERS) for m in _MEASURES
}
METRICS50 |= {
    "N": agg("COUNT"),
    "MEAN": agg("AVG", "amount"),
    "TOP": agg("MAX", "soldeconvertie", cond("actif", "=", 1)),
    "WEIGHTED": agg("SUM", expression=op("MULTIPLY", field("soldeconvertie"), value(0.15))),
    "GAP": op("SUBTRACT", agg("SUM", "cumulmvtdb", cond("actif", "=", 1)), agg("SUM", "cumulmvtcr", cond("actif", "=", 0))),
}
assert len(METRICS50) == 50
_CODES = list(METRICS50)


def _param(code):
    return {"type": "PARAM", "code": code}


RATIOS28 = {f"R{i}": op("DIVIDE", _param(_CODES[i]), op("ADD", _param(_CODES[-1 - i]), {"type": "CONSTANT", "value": 1})) for i in range(28)}
SHOCKS2 = [
    {"operation": "ADD", "field": "soldeconvertie", "value": 5, "filters": cond("actif", "=", 1)},
    {"operation": "SUBTRACT", "field": "cumulmvtdb", "value": 5, "filters": cond("actif", "=", 1)},
]

"""Labels, code maps and parts of text codes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

# Product class codes and their names.
CLASS_NAMES = {
    "26ACE": "ACESSORIOS",
    "26AER": "AEROSOL & INFLAMAVEIS",
    "26ALM": "ALIMENTOS",
    "26BEB": "BEBIDAS",
    "26BDC": "BENS DE CONSUMO",
    "26COF": "COFRE DIVERSOS",
    "26COL": "COLCHAO BOX",
    "26DIV": "DIVERSOS",
    "26ECC": "ESTOFADOS",
    "26FAR": "FARMACIA",
    "26HIG": "HIGIENE",
    "26EIS": "INFORMATICA",
    "26LIM": "LIMPEZA",
    "26LNB": "LINHA BRANCA",
    "26MOV": "MOVEIS",
    "26NVD": "NOTEBOOK",
    "26PAP": "PAPELARIA",
    "26PER": "PERFUMARIA",
    "26PET": "PETS & CIA",
    "26PNE": "PNEUS",
    "26PDE": "PONTA DE ESTOQUE",
    "26SAM": "LIMPEZA",
    "26TEC": "TECNICO",
    "26TV": "TV - IMAGEM",
    "VND": "VENDIDOS",
}

# Station names shown under another label.
STATION_LABELS = {
    "MOVEIS  (28 - 33)": "MOVEIS",
    "COFRE": "COFRE",
    "DIVERSOS P (04 A 14)": "DIVERSOS",
    "COLCHAO & ESTOFADO G18- G21)": "COLCHAO & ESTOFADO",
    "PICKING COURIER (DIVERSOS)": "COURIER",
    "LINHA BRANCA (21 - 27)": "LINHA BRANCA",
    "TV + PNEU RUA 16 A 18": "TV E PNEU",
    "MERCADO": "BENS DE CONSUMO",
    "PICKING STAGER (ELETRO+ESTOFADO+COLCHAO)": "GRANPICK",
    "GENERICO+DOCA+TEC": "GENERICO",
}

# Storage levels and occupancy codes.
LEVEL_NAMES = {"S": "BAIXO", "N": "ALTO"}
OCCUPANCY_NAMES = {"42": "VAZIO", "45": "OCUPADO", "47": "OCUPADO"}

# Column ranges of the blocks, by building.
BLOCKS = {
    ("P",): {"1 BLOCO": ("000", "037"), "2 BLOCO": ("038", "075"), "3 BLOCO": ("076", "199")},
    ("B", "G"): {"1 BLOCO": ("000", "033"), "2 BLOCO": ("034", "067"), "3 BLOCO": ("068", "199")},
}

# Delivery texts of the carriers and the labels shown for them.
DELIVERY_LABELS = {
    "Endere o do Cliente Destino n o Localizado": "Endereço Não_Localizado",
    "Em rota de entrega": "Em Entrega",
    "1a Tentativa Cliente Ausente": "1a_Tentativa Cliente_Ausente",
    "Saiu para Entrega": "Saiu_para Entrega",
    "Troca de transportadora": "Troca transportadora",
}


def _as_column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def classify(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """First matching ``(predicate, label)``; labels may be columns."""
    rules = list(rules)
    chain = F.when(rules[0][0], _as_column(rules[0][1]))
    for predicate, label in rules[1:]:
        chain = chain.when(predicate, _as_column(label))
    return chain.otherwise(_as_column(default))


def _sql_literal(value: object) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def decode_values(value: Column, labels: Mapping[object, object], default: object = None) -> Column:
    """Label of each listed value; other values and NULL give ``default``."""
    entries = ", ".join(f"{_sql_literal(key)}, {_sql_literal(label)}" for key, label in labels.items())
    found = F.try_element_at(F.expr(f"map({entries})"), value)
    return found if default is None else F.coalesce(found, _as_column(default))


def class_name(code: Column) -> Column:
    """Product class name; an unknown or missing code gives NULL."""
    return decode_values(code, CLASS_NAMES)


def station_label(station: Column) -> Column:
    return decode_values(station, STATION_LABELS, station)


def delivery_label(text: Column) -> Column:
    return decode_values(text, DELIVERY_LABELS)


def concat_code(code: Column, digit: Column) -> Column:
    """Code and check digit as one text; a missing part counts as empty."""
    return F.concat_ws("", code.cast("string"), digit.cast("string"))


def address_parts(address: Column) -> dict[str, Column]:
    """Building, street, column, level and room cut from a storage address."""
    return {
        "predio": F.substring(address, 1, 1),
        "rua": F.substring(address, 1, 3),
        "coluna": F.substring(address, 4, 3),
        "nivel2": F.substring(address, 7, 3),
        "sala": F.substring(address, 10, 3),
    }


def address_block(building: Column, column: Column) -> Column:
    """Block of a storage column, compared as text; empty when there is none."""
    rules = []
    for buildings, blocks in BLOCKS.items():
        inside = building.isin(*buildings)
        rules += [(inside & column.between(*limits), block) for block, limits in blocks.items()]
    return classify(rules, "")


def parity(column: Column) -> Column:
    """``PAR`` for even column numbers, else ``IMPAR``."""
    return F.when(column.try_cast("int") % 2 == 0, "PAR").otherwise("IMPAR")


def token_number(text: Column, position: int, mark: str = "#") -> Column:
    """Number in front of the ``position``-th mark (from 0) of ``a#b#...`` text.

    Text with fewer than two marks, or a part that is no number, gives NULL.
    """
    parts = F.split(text, mark)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(position)).try_cast("bigint"))


def pad3(column: Column) -> Column:
    return F.lpad(column, 3, "0")


def appointment_kind(external_id: Column) -> Column:
    """``LV`` for external ids that start with ``INS``; anything else is ``RECEBIMENTO``."""
    return F.when(external_id.startswith("INS"), "LV").otherwise("RECEBIMENTO")


def pad2(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")

"""Domain dictionaries: units, plausible ranges, regions, question stems, synonyms. Each is data; a folder of files can replace it."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from pathlib import Path

# -- fixed values --------------------------------------------------------------------------------------------------

#: (kind, unit, dimension, factor to the base unit, offset in base units, spellings)
UNITS = (
    ("temperature", "C", "temperature", 1.0, 0.0, ("c", "°c", "с", "°с", "ос", "oc")),
    ("temperature", "C", "temperature", 1.0, -273.15, ("K", "К", "кельвин", "кельвина", "кельвинов", "kelvin")),
    ("duration", "h", "duration", 1.0, 0.0, ("h", "ч", "час", "часа", "часов", "часами")),
    ("duration", "h", "duration", 1 / 60, 0.0, ("мин", "минут", "минута", "минуты", "минуту", "минутами", "min")),
    ("duration", "h", "duration", 1 / 3600, 0.0, ("сек", "секунд", "секунда", "секунды", "секунду", "секундами", "sec", "s")),
    ("relative_effect", "%", "relative_effect", 1.0, 0.0, ("%",)),
    ("concentration", "mg/L", "concentration", 1.0, 0.0, ("мг/л", "мг/дм3", "мг/дм³", "mg/l", "mg/dm3", "mg/dm³", "ppm")),
    ("concentration_high", "g/L", "concentration", 1000.0, 0.0, ("г/л", "г/дм3", "г/дм³", "g/l", "g/dm3", "g/dm³")),
    ("concentration_trace", "g/t", "concentration_trace", 1.0, 0.0, ("г/т", "g/t")),
    ("pressure", "MPa", "pressure", 1.0, 0.0, ("mpa", "мпа")),
    ("pressure", "MPa", "pressure", 0.1, 0.0, ("bar", "бар")),
    ("pressure", "MPa", "pressure", 0.101325, 0.0, ("atm", "атм")),
    ("length", "mm", "length", 1.0, 0.0, ("mm", "мм")),
    ("length_m", "m", "length", 1000.0, 0.0, ("m", "м")),
    ("length_um", "um", "length", 0.001, 0.0, ("мкм", "μm", "um")),
    ("voltage", "V", "voltage", 1.0, 0.0, ("v", "в")),
    ("voltage_mv", "mV", "voltage", 0.001, 0.0, ("mv", "мв")),
    ("flow_rate", "m3/h", "flow_rate", 1.0, 0.0, ("м3/ч", "м³/ч", "m3/h")),
    ("mass_flow", "t/h", "mass_flow", 1.0, 0.0, ("т/ч", "t/h")),
    ("mass_flow", "t/h", "mass_flow", 1 / 24, 0.0, ("т/сут", "т/сутки", "t/day")),
    ("velocity", "m/s", "velocity", 1.0, 0.0, ("м/с", "m/s")),
    ("force", "kgf", "force", 1.0, 0.0, ("kgf", "кгс")),
    ("current_density", "A/m2", "current_density", 1.0, 0.0, ("a/m2", "а/м2", "а/м²")),
    ("specific_energy", "kWh/t", "specific_energy", 1.0, 0.0, ("квт·ч/т", "kwh/t")),
    ("turbidity", "NTU", "turbidity", 1.0, 0.0, ("ntu",)),
    ("conductivity", "mS/cm", "conductivity", 1.0, 0.0, ("мсм/см", "ms/cm")),
    ("dimensionless", "pH", "dimensionless", 1.0, 0.0, ("ph",)),
)

#: quantity: (dimension, unit, factor from the base unit)
QUANTITIES = {
    "temperature": ("temperature", "C", 1.0),
    "duration": ("duration", "h", 1.0),
    "relative_effect": ("relative_effect", "%", 1.0),
    "flow_rate": ("flow_rate", "m3/h", 1.0),
    "force": ("force", "kgf", 1.0),
    "pressure": ("pressure", "MPa", 1.0),
    "pressure_bar": ("pressure", "bar", 10.0),
    "pressure_atm": ("pressure", "atm", 9.869232667),
    "length": ("length", "mm", 1.0),
    "length_m": ("length", "m", 0.001),
    "length_um": ("length", "um", 1000.0),
    "voltage": ("voltage", "V", 1.0),
    "voltage_mv": ("voltage", "mV", 1000.0),
    "current_density": ("current_density", "A/m2", 1.0),
    "specific_energy": ("specific_energy", "kWh/t", 1.0),
    "mass_flow": ("mass_flow", "t/h", 1.0),
    "velocity": ("velocity", "m/s", 1.0),
    "concentration": ("concentration", "mg/L", 1.0),
    "concentration_high": ("concentration", "g/L", 0.001),
    "concentration_trace": ("concentration_trace", "g/t", 1.0),
    "dimensionless": ("dimensionless", "pH", 1.0),
    "turbidity": ("turbidity", "NTU", 1.0),
    "conductivity": ("conductivity", "mS/cm", 1.0),
}

#: Plausible ranges of named parameters, in order: (name, quantity, least, most).
RANGES = (
    ("скорость потока", "flow_rate", 0.1, 500),
    ("плотность тока", "current_density", 100, 500),
    ("выход по току", "relative_effect", 80, 100),
    ("перенапряжение", "voltage", 0.1, 10),
    ("температура электролита", "temperature", 0, 100),
    ("сухой остаток", "concentration", 0, 25000),
    ("TDS", "concentration", 0, 25000),
    ("гидростатический напор", "length_m", 0.1, 100),
    ("депрессионная воронка", "length_m", 0, 50000),
    ("производительность", "flow_rate", 1, 50000),
    ("pH", "dimensionless", 0, 14),
    ("окислительно-восстановительный потенциал", "voltage_mv", -500, 800),
    ("степень удаления", "relative_effect", 0, 100),
    ("мутность", "turbidity", 0, 1000),
    ("электропроводность", "conductivity", 0.1, 100),
    ("размер пор мембраны", "length_um", 0.0001, 5),
    ("содержание Ni в электролите", "concentration_high", 40, 80),
    ("концентрация H3BO3", "concentration_high", 5, 15),
    ("межэлектродное расстояние", "length", 20, 100),
    ("толщина катодного осадка", "length", 1, 10),
    ("расход электроэнергии", "specific_energy", 2000, 6000),
    ("коэффициент распределения", "dimensionless", 0, 100000),
    ("сортность штейна", "relative_effect", 0, 100),
    ("температура", "temperature", 0, 1600),
    ("извлечение Cu", "relative_effect", 0, 100),
    ("остаточное содержание Cu", "relative_effect", 0, 50),
    ("извлечение благородных металлов", "relative_effect", 0, 100),
    ("содержание металла в руде", "concentration_trace", 0.1, 1000),
    ("расход реагента", "concentration_trace", 1, 10000),
    ("влажность", "relative_effect", 0, 100),
    ("крупность", "length", 0.001, 200),
    ("класс менее 0,05 мм", "relative_effect", 0, 100),
    ("холодная прочность", "force", 1, 1000),
    ("давление прессования", "pressure", 0.01, 300),
    ("производительность пресса", "mass_flow", 0.1, 1400),
    ("время выдержки", "duration", 0.1, 168),
    ("парциальное давление", "pressure", 0, 10),
)

#: Regions in order; the first is the domestic one. Markers match at starts of words.
REGIONS = {
    "Россия": ("росси", "отечествен", "норильск", "талнах", "надеждинск", "заполярный филиал", "кольск", "мончегорск", "печенг", "красноярск", "nornik", "norilsk"),
    "Канада": ("канад", "canada", "sudbury", "copper cliff", "thompson", "inco", "falconbridge"),
    "Норвегия": ("норвеж", "норвеги", "norway", "nikkelverk", "kristiansand"),
    "Финляндия": ("финлянд", "финск", "finland", "harjavalta", "outokumpu", "kokkola", "aalto"),
    "Япония": ("япон", "japan", "niihama", "sumitomo", "toyo smelter"),
    "Китай": ("китай", "китае", "китая", "китайск", "china", "jinchuan"),
    "Чили": ("чили", "chile", "caletones", "chuquicamata", "codelco", "teniente"),
    "Замбия": ("замби", "zambia", "nkana", "rokana", "медного пояса", "copperbelt"),
    "ЮАР": ("юар", "south africa", "rustenburg", "waterval", "anglo american"),
    "США": ("сша", "u.s.a", "united states", "кеннекотт", "kennecott"),
    "Германия": ("германи", "немецк", "germany", "aurubis", "norddeutsche"),
    "Австралия": ("австрали", "australia", "kalgoorlie", "olympic dam"),
    "Бразилия": ("бразил", "brazil", "onca puma"),
    "Польша": ("польш", "польск", "poland", "kghm", "glogow", "legnica"),
    "Казахстан": ("казахстан", "kazakhstan", "балхаш", "жезказган"),
    "Ботсвана": ("ботсван", "botswana", "selebi"),
    "Индонезия": ("индонези", "indonesia", "soroako", "weda bay"),
    "Зимбабве": ("зимбабв", "zimbabwe", "bindura"),
    "Конго": ("конго", "congo", "katanga", "катанг"),
}

#: Starts of words that keep a question in the domain.
STEMS = (
    "метод", "экспер", "исслед", "публика", "отчет", "лаборат", "температур", "концентрац", "скорост", "давлен", "расход", "материал",
    "процесс", "оборудован", "установк", "технолог", "параметр", "режим", "источник", "статья", "патент", "вывод", "эффект", "практик",
    "раствор", "очистк", "вода", "воды", "руда", "руды", "металл", "сплав", "шлак", "штейн",
)

#: Node types that extracted entities may take, and the relations between them that are kept.
SEMANTIC_TYPES = ("Process", "Equipment", "Condition")

# ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Domain:
    """The dictionaries in use. synonyms: folded alias -> canonical name."""

    units: tuple = UNITS
    quantities: dict = field(default_factory=lambda: dict(QUANTITIES))
    ranges: tuple = RANGES
    regions: dict = field(default_factory=lambda: dict(REGIONS))
    stems: tuple = STEMS
    synonyms: dict = field(default_factory=dict)


def fold(value: str) -> str:
    return " ".join(value.strip().lower().replace("ё", "е").split())


def load(folder: str | Path) -> Domain:
    """Dictionaries from a folder: synonyms.csv (canonical, alias), units.yaml, validation-rules.yaml, regions.yaml; what is missing keeps its default."""
    folder, found = Path(folder), {}
    if (path := folder / "synonyms.csv").exists():
        synonyms = {}
        with path.open(encoding="utf-8-sig", newline="") as f:
            for row in csv.DictReader(f):
                name, alias = (row.get("canonical") or "").strip(), (row.get("alias") or "").strip()
                if name and alias:
                    synonyms |= {fold(alias): name, fold(name): name}
        found["synonyms"] = synonyms
    yamls = {n: folder / f"{n}.yaml" for n in ("units", "validation-rules", "regions")}
    if any(p.exists() for p in yamls.values()):
        import yaml

        read = {n: yaml.safe_load(p.read_text(encoding="utf-8")) or {} for n, p in yamls.items() if p.exists()}
        if "units" in read:
            groups = (read["units"].get("units") or {}).items()
            found["units"] = tuple((u.get("kind", k), u["unit"], u["dimension"], float(u["to_base"]), float(u.get("offset") or 0), tuple(map(str, u.get("aliases") or ()))) for k, u in groups)
            found["quantities"] = {k: (q["dimension"], q["unit"], float(q["from_base"])) for k, q in (read["units"].get("quantities") or {}).items()}
        if "validation-rules" in read:
            found["ranges"] = tuple((k, p.get("quantity"), p["min"], p["max"]) for k, p in (read["validation-rules"].get("params") or {}).items() if "min" in p and "max" in p)
        if "regions" in read:
            first = sorted(read["regions"], key=lambda r: not r.get("domestic"))
            found["regions"] = {r["name"]: tuple(r.get("markers") or ()) for r in first}
    return Domain(**found)

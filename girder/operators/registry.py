"""The extension surface: operators that yield elements and relationships, found by name, called with plain arguments."""

from __future__ import annotations

import inspect
import typing
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame


class Ingester(ABC):
    """Yields elements and relationships of one model as DataFrames."""

    @abstractmethod
    def extract(self, tables: dict[str, DataFrame]) -> None: ...

    @abstractmethod
    def elements(self) -> DataFrame: ...

    @abstractmethod
    def relationships(self) -> DataFrame: ...

    def artifacts(self) -> dict[str, DataFrame]:
        return {}

    def summary(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.relationships().groupBy("relationship_type").agg(F.count("*").alias("n"))


class Recipe(ABC):
    """A patch of a model's tables: made with its arguments, run by ``patch``, read by ``output``."""

    def __init__(self, tables: dict[str, DataFrame], **arguments: object):
        self.tables, self.arguments = dict(tables), arguments

    @abstractmethod
    def patch(self) -> None: ...

    def output(self) -> dict[str, DataFrame]:
        return self.tables


def run_recipe(kind: type[Recipe], tables: dict[str, DataFrame], *args: object, **named: object) -> dict[str, DataFrame]:
    """Make a recipe with plain arguments (positions become names, texts the annotated types), patch, return its output."""
    signature = inspect.signature(kind.__init__)
    hints = typing.get_type_hints(kind.__init__)
    order = [p for p in signature.parameters if p not in ("self", "tables") and signature.parameters[p].kind is not inspect.Parameter.VAR_KEYWORD]
    if len(args) > len(order):
        raise TypeError(f"{kind.__name__} takes {len(order)} arguments")
    given = dict(zip(order, args, strict=False)) | named
    if unknown := set(given) - set(order):
        raise TypeError(f"{kind.__name__} has no arguments {sorted(unknown)}")
    recipe = kind(tables, **{k: coerce(v, hints.get(k, str)) for k, v in given.items()})
    recipe.patch()
    return recipe.output()


def load_mapping(package: str, module: str, *needed: str):
    """A mapping module of a package by its bare name; one that lacks a needed name is refused, as are dotted names."""
    import importlib

    if not module.isidentifier():
        raise ValueError(f"not the name of a mapping module: {module!r}")
    try:
        mapping = importlib.import_module(f"{package}.{module}")
    except ImportError as error:
        raise ValueError(f"no mapping module {module!r}") from error
    missing = [n for n in needed if not hasattr(mapping, n)]
    if missing:
        raise ValueError(f"{module} has no {', '.join(missing)}")
    return mapping


#: The property that names another owner of an element.
OWNER = ("BIP-PROCESS", "DuplicateOwnedBy")


class AssignByRules(Recipe):
    """Writes a value by the ordered rules of a mapping module: ``RULES``, pairs of a selector and a value, and
    ``valid(value)``. Elements (guid, entity), properties (guid, pset, prop, value)."""

    def __init__(self, tables: dict[str, DataFrame], package: str, mapping_module: str, pset: str, prop: str, overwrite: bool = False):
        super().__init__(tables)
        self.mapping = load_mapping(package, mapping_module, "RULES", "valid")
        self.pset, self.prop, self.overwrite = pset, prop, overwrite

    def patch(self) -> None:
        from pyspark.sql import functions as F

        from . import rules, selectors

        elements, properties = self.tables["elements"], self.tables["properties"]
        fits = elements.select("guid")
        wanted = [(s, v) for s, v in self.mapping.RULES if s and v and self.mapping.valid(v)]
        for i, (selector, _) in enumerate(wanted):
            own = selectors.select_union(elements, properties, selector).withColumn(f"_r{i}", F.lit(True))
            fits = fits.join(own, "guid", "left")
        value = lambda pset, prop: properties.where((F.col("pset") == pset) & (F.col("prop") == prop)).groupBy("guid").agg(F.min("value").alias(f"_{prop}"))
        fits = fits.join(value(*OWNER), "guid", "left").join(value(self.pset, self.prop), "guid", "left")
        assigned = rules.assign_by_rules(fits, "guid", [(F.col(f"_r{i}"), v) for i, (_, v) in enumerate(wanted)], F.col(f"_{OWNER[1]}"), F.col(f"_{self.prop}"), self.overwrite)
        self.tables["assigned"] = assigned
        written = assigned.where("written").select("guid", "assigned")
        self.tables["properties"] = rules.write_property(properties, written, self.pset, self.prop, F.col("assigned"))


_KNOWN: dict[str, Callable] = {}
_OLD_NAMES: dict[str, dict[str, str]] = {}


def register(name: str, old_names: dict[str, str] | None = None):
    """Register a callable; ``old_names`` maps former argument names to present ones."""

    def add(f: Callable) -> Callable:
        if name in _KNOWN:
            raise ValueError(f"{name} is registered already")
        _KNOWN[name] = f
        _OLD_NAMES[name] = dict(old_names or {})
        return f

    return add


def parameters(name: str) -> list[tuple[str, str, object]]:
    """(name, type, default) of the plain arguments of a registered callable."""
    hints = typing.get_type_hints(_KNOWN[name])
    out = []
    for p in inspect.signature(_KNOWN[name]).parameters.values():
        default = None if p.default is inspect.Parameter.empty else p.default
        out.append((p.name, getattr(hints.get(p.name), "__name__", "str"), default))
    return out


def coerce(value: object, kind: type) -> object:
    """Text arguments by the annotated type: yes-words are true, blank numbers are None."""
    if not isinstance(value, str) or kind is str:
        return value
    text = value.strip()
    if kind is bool:
        return text.lower() in ("1", "true", "yes", "on", "y")
    if kind in (int, float):
        return None if text.lower() in ("", "none", "null", "undefined") else kind(text)
    if kind is list or typing.get_origin(kind) is list:
        return [x.strip() for x in text.split(",") if x.strip()]
    return value


def call(name: str, *args: object, **named: object) -> object:
    """Call by name: positions become names, old names present ones, texts the annotated types; unknown names fail."""
    f = _KNOWN[name]
    hints = typing.get_type_hints(f)
    order = list(inspect.signature(f).parameters)
    if len(args) > len(order):
        raise TypeError(f"{name} takes {len(order)} arguments")
    given = dict(zip(order, args, strict=False))
    for key, value in named.items():
        key = _OLD_NAMES[name].get(key, key)
        if key not in order:
            raise TypeError(f"{name} has no argument {key!r}")
        given[key] = value
    return f(**{k: coerce(v, hints.get(k, str)) for k, v in given.items()})


def names() -> list[str]:
    return sorted(_KNOWN)

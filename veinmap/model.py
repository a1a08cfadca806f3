"""The data model: an ontology as four DataFrames, each with ``pos`` because list order has a meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

CLASS = "pos long, name string, class_name string, comment string, uri string, sub_class_of array<string>, sub_class_of_present boolean, parent_class array<string>"
PROPERTY = "pos long, name string, domain string, range string, uri string"
#: attrs: every other key as Python's str() prints it; nums: those whose value is a number or boolean.
INDIVIDUAL = "pos long, name string, class array<string>, class_is_list boolean, type array<string>, type_is_list boolean, classes array<string>, attrs map<string,string>, nums map<string,double>"


@dataclass(frozen=True)
class Ontology:
    classes: DataFrame
    object_properties: DataFrame
    datatype_properties: DataFrame
    individuals: DataFrame
    metadata: str | None = None


@dataclass(frozen=True)
class Graph:
    """nodes: id, name, type, ...; edges: pos, from, to, type."""

    nodes: DataFrame
    edges: DataFrame

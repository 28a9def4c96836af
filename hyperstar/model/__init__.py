"""The logical model: marts, dimensions, hierarchies, levels and attributes."""

from .attributes import Attribute, Measure, MeasureAggregate
from .cube import Cube
from .dimension import Dimension, Hierarchy, Level
from .provider import ModelProvider, StaticProvider, read_model, write_bundle

__all__ = ["Attribute", "Cube", "Dimension", "Hierarchy", "Level", "Measure", "MeasureAggregate", "ModelProvider", "StaticProvider", "read_model", "write_bundle"]

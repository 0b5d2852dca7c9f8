"""Objects over the DataFrames: graphs, matrices, vectors, atoms and image sets.

Each object holds immutable DataFrames; methods that change an object in place
bind it to a new plan. Nothing runs before a value is asked for.
"""

from tesserae.api.atoms import AtomGraph
from tesserae.api.graph import BlockGraph
from tesserae.api.images import ImageSet
from tesserae.api.matrix import AssemblyMode, BlockMatrix
from tesserae.api.vector import MultiVector, Vector

__all__ = ["AssemblyMode", "AtomGraph", "BlockGraph", "BlockMatrix", "ImageSet", "MultiVector", "Vector"]

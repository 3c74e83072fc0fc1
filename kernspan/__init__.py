"""Kernel-subspace analytics on Spark DataFrames.

Sub-packages
------------
``sources``    readers and writers of labelled vector tables
``functions``  Column-level helpers: vectors, images, kernels, hash uniforms
``operators``  DataFrame -> DataFrame operators: statistics, packing, sampling,
               fitting, scoring, subspace collections, classifiers, ridge
``plans``      the iterative landmark-selection plans built from the operators
``streaming``  scoring a stream with already fitted models
"""

from kernspan.functions.kernels import cosine, custom, linear, poly, rbf
from kernspan.session import configured_builder, materialize, ship_package

__all__ = [
    "configured_builder",
    "cosine",
    "custom",
    "linear",
    "materialize",
    "poly",
    "rbf",
    "ship_package",
]

"""Spatially regularised mixture deconvolution on Spark."""

from mixspark.plans.deconvolve import Deconvolution, deconvolve, multiscale

__all__ = ["Deconvolution", "deconvolve", "multiscale"]

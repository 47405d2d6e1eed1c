"""Operators: each turns a frame into another one."""

from .lowering import Lowering

__all__ = ["Lowering"]

"""Shared scratch tables, see :mod:`tallyframe.scratch`."""

from ..scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]

"""Views kept over the transitions."""

from .base import DeltaObserver, Observer, replay_with
from .graphs import AsGraph, AsMultigraph
from .paths import PathCounts
from .updates import UpdateCounts

__all__ = ["AsGraph", "AsMultigraph", "DeltaObserver", "Observer", "PathCounts", "UpdateCounts", "replay_with"]

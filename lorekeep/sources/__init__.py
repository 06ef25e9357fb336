"""Readers of exports; importing the package registers all of them."""

from . import chats, exports, files

__all__ = ["chats", "exports", "files"]

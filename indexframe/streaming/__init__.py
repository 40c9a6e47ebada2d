"""Event-time windows.  An extension: batch queries come first in this engine."""

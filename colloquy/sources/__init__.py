from colloquy.sources import sinks, text
from colloquy.sources.tables import table

__all__ = ["sinks", "table", "text"]

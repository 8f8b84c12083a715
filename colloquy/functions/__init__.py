from colloquy.functions import dialogue, judge, labels, text

__all__ = ["dialogue", "judge", "labels", "text"]

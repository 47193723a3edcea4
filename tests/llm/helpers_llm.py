import re

SPACE_RUN = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    """The words of a text."""
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

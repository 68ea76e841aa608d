"""The watched folder and the live timeline as structured streams."""

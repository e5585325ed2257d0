"""Part of linkspark."""

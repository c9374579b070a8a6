"""Part of assize; see the README for the layout."""

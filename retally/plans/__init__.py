"""Views and the reports over them."""

"""Print-artwork quality analytics over tables of extracted page, font, image and drawing-event records."""

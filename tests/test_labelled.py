from tideline.queries.models import labelled_documents


def test_texts_are_read_once(spark, sf):
    """Training scans the features many times; none of these scans goes back to the texts."""
    files = labelled_documents(spark, sf).inputFiles()
    assert files and not [f for f in files if "documents" in f]

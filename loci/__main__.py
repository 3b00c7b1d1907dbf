from loci.cli import main

raise SystemExit(main())
